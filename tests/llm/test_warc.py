"""Archives: exact round trips, ZIP64, odd rows."""

import io
import zipfile

from semid.llm.warc_zip import archive_round_trip, central_directory, data_offset, digest, locate_records, mark_revisits, read_records, write_archives

ROWS = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "http://c\r\nEvil: 1", ""), (5, "http://e", "<p>x</p>"), (4, "http://d", "é" * 200_000), (6, "http://f", "<p>x</p>"), (6, "http://f", "<p>x</p>"), (None, "n", "<p>x</p>"), (7, "b", "WARC/1.1\r\n\r\nxx\r\n\r\n")]


def _want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(h or "") if len(p) >= least else None
        again = f is not None and i != f
        out.append((i, len(p), digest(p), "revisit" if again else "response", f if again else None))
    return sorted(map(repr, out))


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 as key", "2 as path", "3 as salt")
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for least in (0, 4):
        got = archive_round_trip(spark, df, least=least).collect()
        assert sorted(repr(tuple(r[c] for c in cols)) for r in got) == _want(ROWS, least)
    whole = {r["page_id"]: r["html"] for r in archive_round_trip(spark, df, with_payload=True).collect() if r["record_type"] == "response"}
    assert whole[4] == "é" * 200_000 and whole[7] == ROWS[-1][2] and whole[2] == ""
    assert archive_round_trip(spark, df.where("page_id > 100")).count() == 0


def test_ids_of_any_text(spark):
    ids = ["a b", "x\r\nEvil: 1", "100%", "é", "", "None", None, "q>", "a b"]
    df = spark.createDataFrame([(i, None, f"<p>{k % 4}</p>") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = archive_round_trip(spark, df).collect()
    assert sorted(repr(r["page_id"]) for r in got) == sorted(map(repr, ids))
    least = {h: min(i for k, i in enumerate(ids) if k % 4 == h and i is not None) for h in range(4)}
    assert {r["page_id"]: r["refers_to"] for r in got if r["refers_to"] is not None} == {i: least[k % 4] for k, i in enumerate(ids) if i != least[k % 4]}


def test_null_ids_beside_equal_payloads(spark):
    df = spark.createDataFrame([(None, "u", "<p>"), (5, "u", "<p>"), (3, "u", "<p>"), (None, "u", "alone"), (None, "u", "alone")], "page_id bigint, url string, html string")
    got = sorted(repr((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])) for r in archive_round_trip(spark, df).collect())
    assert got == sorted(map(repr, [(None, 3, "revisit", 3), (5, 3, "revisit", 3), (3, 3, "response", None), (None, 5, "response", None), (None, 5, "response", None)]))


def test_archives_roll_over_and_are_read_by_range(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", str(i) * 3000) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    manifest = write_archives(mark_revisits(df), f"file://{tmp_path}/a", archive_bytes=500)
    assert manifest.count() > 3
    ranges = locate_records(manifest)
    assert ranges.count() == 50 and read_records(ranges.where("offset % 2 = 0")).count() < 50


def test_central_directory_with_and_without_zip64(monkeypatch):
    for limit in (None, 10):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name in ("indexes/é", "b/c", "d"):
                z.writestr(name, f"body of {name} " * 20)
            z.comment = b"PK and more"
        raw = out.getvalue()
        read = lambda at, n, raw=raw: raw[at : at + n]
        members = central_directory(read, len(raw))
        assert [m.name for m in members] == ["indexes/é", "b/c", "d"]
        assert all(read(data_offset(read, m), m.size).decode() == f"body of {m.name} " * 20 for m in members)
        assert (b"PK\x06\x06" in raw) == bool(limit)
