"""Exact dedup, line dedup and secret scans: SQL on the test tables, brute force on odd rows."""

import hashlib
import re

import pytest
from conftest import ODD  # noqa: F401  (tests/llm/conftest.py)
from pyspark.sql import functions as F

from semid.llm import queries as L
from semid.llm.exact_dedup import exact_dedup, exact_groups
from semid.llm.line_dedup import LineRuns, dedup_lines, line_runs, line_table
from semid.llm.secret_scan import RULES, postings, redact, scan_report, secret_spans, vocabulary
from semid.llm.trigrams import derive


@pytest.mark.parametrize("name", sorted(L.ORACLES))
def test_query_equals_sql(name, same):
    same(L.QUERIES[name], L.ORACLES[name])


def _groups(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.substring(F.md5(t), 1, 2)), lambda t: F.unhex(F.lit("00"))])
def test_exact_groups_of_odd_rows(odd, digest):
    """Weak digests put different texts under one digest; content decides all the same."""
    rows = exact_groups(odd, **({"digest": digest} if digest else {})).collect()
    groups = _groups(ODD)
    want = []
    for t, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        want += [(i, keep, len(ids), i == keep) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in rows)


def test_exact_dedup_keeps_one_of_each(odd, none):
    kept = exact_dedup(odd).collect()
    assert sorted((r["text"] or "") for r in kept) == sorted({t or "" for _, t in ODD}) and "block" in kept[0].asDict()
    assert exact_groups(none).count() == exact_dedup(none).count() == 0


def _lines(rows, least_docs):
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= least_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least_docs", [2, 4, 100])
def test_lines_of_odd_rows(spark, odd, none, least_docs):
    rows = [*ODD, (20, " ONE \nx\none\nrest"), (21, "x \r\nlast")]
    extra = spark.createDataFrame(rows[len(ODD) :], "doc_id bigint, text string")
    got = dedup_lines(odd.select("doc_id", "text").unionByName(extra), least_docs=least_docs)
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in got.collect()) == _lines(rows, least_docs)
    assert dedup_lines(odd, least_docs=least_docs, carry=("hash",)).count() == len(ODD)
    assert dedup_lines(none).count() == 0


def test_runs_compact_and_know_what_they_have_seen(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("_row"), F.col("text").alias("_text"))
    lines = line_table(docs)
    a, b = (line_runs(lines.withColumn("batch", F.pmod(F.xxhash64("_row"), F.lit(n))), n) for n in (1, 7))
    assert [len(x) for x in b.levels] == [1, 1, 1] and a.totals().exceptAll(b.totals()).count() == b.totals().exceptAll(a.totals()).count() == 0
    held = [b._read(p) for p in b.paths]
    assert sum(x.count() for x in held) == a.totals().count() == lines.select("hash").distinct().count()
    again = LineRuns(spark, b.folder, state=b.state)
    new = line_table(spark.createDataFrame([(b"x", "never seen before")], "_row binary, _text string"))
    assert again.unseen(lines).count() == 0 and again.unseen(new).count() == 1
    again.add(new.select("hash"))
    assert again.totals().count() == a.totals().count() + 1
    plan = again.unseen(again._read(again.paths[0]))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and "Exchange" not in plan
    for r in (a, b, again):
        r.forget()


def test_trigram_queries():
    assert derive("[0-9a-f]{32,}") == [] and derive("AKIA[A-Z0-9]{12,}") == [[frozenset({"aki", "kia"})]]
    assert derive("ab?c(def|xyz)") == [[frozenset({"acd", "cde", "def"}), frozenset({"acx", "cxy", "xyz"}), frozenset({"abc", "bcd", "cde", "def"}), frozenset({"abc", "bcx", "cxy", "xyz"})]] or len(derive("ab?c(def|xyz)")[0]) == 4
    found = derive(RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in found[0] and len(found[0]) == 6


def _spans(text):
    kinds = [("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    kinds += [(r.kind, r.pattern, r.group, r.least) for r in RULES[3:]]
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(kinds[k][0], s, e) for s, k, e in sorted(found)]


SECRETS = [
    "password=token:abcdefghij token=abc secret : 'abcdefgh' api_key=\"12345678\" APIKEY=abcdefgh1", "é AKIA AKIAX AKIAABCDEFGHIJKL1 xAKIAABCDEFGHIJKLMNO-AKIA", "f" * 31 + " " + "0" * 40 + "g" + "a" * 32,
    "-----BEGIN RSA PRIVATE KEY-----\nghp_" + "a" * 36 + " eyJabcdefgh.abcdefgh.abcdefgh", "passwd = deadbeefdeadbeefdeadbeefdeadbeef", "secrets tokens", "tokenize = x", None, "",
]


def test_spans_by_brute_force(spark, odd, none):
    rows = ODD + [(100 + i, t) for i, t in enumerate(SECRETS)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(ODD) :], "doc_id bigint, text string"))
    got = sorted(repr((r["doc_id"], r["spans"], r["base_sha256"], r["n_hex"])) for r in scan_report(df).collect())
    want = []
    for i, t in rows:
        spans = _spans(t or "")
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        spell = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        want.append(repr((i, spell(spans), hashlib.sha256(spell(base).encode()).hexdigest(), sum(k == "hex" for k, _, _ in spans))))
    assert got == sorted(want)
    assert scan_report(none).count() == 0 and secret_spans(odd, carry=("key", "n")).count() == len(ODD)


def test_postings_list_rows_by_trigram(spark):
    rows = spark.createDataFrame([(1, "TOKEN"), (2, "nothing")], "key int, text string")
    grams = vocabulary(RULES)
    got = {(r["key"], grams[r["gram"]]) for r in postings(rows, grams).collect()}
    assert got == {(1, "tok"), (1, "oke"), (1, "ken")}


def test_repeated_ids_are_told_apart_by_text(spark):
    df = spark.createDataFrame([(5, "A"), (9, "B"), (5, "B"), (9, "B"), (1, None), (1, "")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in exact_dedup(df).collect()) == [(1, ""), (5, "A"), (9, "B")]


def test_redaction(odd):
    rows = {r["doc_id"]: r for r in redact(odd).collect()}
    assert rows[11]["text"] == "[secret]\" [secret] [secret]" and rows[1]["text"] is None and rows[4]["spans"] == 5 and len(rows[10]["text"]) == 300_000


def test_private_keys_are_redacted_to_their_end(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\nMIIE" + "abc+/=\n" * 40 + "-----END RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(1, f"x {key} y {key} z"), (2, "-----BEGIN PRIVATE KEY----- without an end"), (3, "-" * 50_000 + "-----BEGIN PRIVATE KEY-----" + " - a" * 50_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert got[1] == "x [secret] y [secret] z" and got[2] == "[secret] without an end" and "[secret]" in got[3]


def test_many_secrets_in_one_text(spark):
    """8,000 spans in one text, some overlapping, against the spans cut out in order."""
    text = "é" + " secret=abcdefgh1 0123456789abcdef0123456789abcdef token = 0123456789abcdef0123456789abcdef," * 2700
    got = redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["text"]
    assert got == "é" + " [secret] [secret] [secret]," * 2700


def test_private_keys_of_any_form(spark):
    """Many hyphens in the header lines, keys of another program, keys cut off before their END line."""
    body = "\n".join("abcd+/12" * 8 for _ in range(20))
    wide = "\r\n".join("Zm9v" * 19 for _ in range(300))
    rows = [
        (1, f"a -----BEGIN EC PRIVATE KEY-----\nNote: {'-x' * 500}\n\n{body}\n-----END EC PRIVATE KEY----- b"),
        (2, f"a -----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-y v2\n\n{body}\n=abcd\n-----END PGP PRIVATE KEY BLOCK----- b"),
        (3, f"a -----BEGIN RSA PRIVATE KEY-----\nDEK-Info: AES-128-CBC,00\n\n{body}\nabcd1234abcd1234==\nand then prose"),
        (4, f"a -----BEGIN PRIVATE KEY-----\r\n{wide}\r\nand then prose"),
        (5, "a -----BEGIN PRIVATE KEY----- is how such a file begins"),
        (6, "-----BEGIN PRIVATE KEY-----\n" + ("Zm9v" * 16 + "\n") * 20_000 + "prose"),
    ]
    got = {r["doc_id"]: r["text"] for r in redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == "a [secret] b"
    assert got[3] == "a [secret]\nand then prose" and got[4] == "a [secret]\r\nand then prose"
    assert got[5] == "a [secret] is how such a file begins" and got[6] == "[secret]\nprose"


def test_one_secret_in_a_long_text(spark):
    text = "é word " * 1_000_000
    df = spark.createDataFrame([(1, f"{text}token=abcdefgh1 {text}")], "doc_id bigint, text string")
    assert redact(df).first()["text"] == f"{text}[secret] {text}"


CLASHES = ("_near_row", "_near_set", "_near_tie", "_exact_digest", "_keep_id", "_text", "_row", "_drop", "_named", "_id", "_doc", "named", "doc", "text_", "s", "p", "counts", "rest", "task", "point", "arc", "enough", "score", "_place")


def test_columns_of_any_name_are_carried(spark):
    """Own names of the operators as extra columns: none is lost or changed."""
    from semid.llm.near_dedup import near_dedup
    from semid.llm.pseudonyms import pseudonymize
    from semid.llm.quality_rules import DecisionList, judge
    from semid.llm.resampling import resample
    from semid.llm.sharding import shard_rows

    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id bigint, text string").selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(CLASHES)])
    want = list(range(len(CLASHES)))
    ways = [exact_dedup(df), near_dedup(df), redact(df), secret_spans(df, carry=CLASHES), dedup_lines(df, carry=CLASHES), pseudonymize(df, "k", carry=CLASHES)]
    other = [c for c in CLASHES if c != "score"]
    for out in ways:
        rows = out.collect()
        assert rows and all([r[c] for c in CLASHES] == want for r in rows)
    for out in (shard_rows(df, 3, carry=other), resample(df, df, carry=other), judge(df, DecisionList(()), carry=other)):
        rows = out.collect()
        assert len(rows) == 3 and all([r[c] for c in other] == [want[CLASHES.index(c)] for c in other] for r in rows)
