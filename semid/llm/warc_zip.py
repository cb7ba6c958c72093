"""WARC records in ZIP-packaged archives, written and read back by ranges.

Every archive is a ZIP file of two stored members: ``archive/data.warc.gz``, each
record a gzip member of its own, and ``indexes/index.cdxj``, a line with the place
of each record. The reader parses the central directory (and the ZIP64 records of
large archives), finds the stored members, reads the indexes by range, and then
each record by its own range; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, whole, written

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
SALTS = 64


def filesystem(path: str):
    """The store a path names (local, HDFS, S3 ...) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    """The page's name in headers and indexes: its id percent-encoded, so that no space or line break can break them; a null id has a name that no id has."""
    return "urn:nopage" if page_id is None else "urn:page:" + quote(str(page_id), safe="")


def page_of(name: str | None) -> str | None:
    return unquote(name.removeprefix("urn:page:")) if name and name.startswith("urn:page:") else None


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit of the page ``refers_to``, whose block ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{urn(page_id)}>"}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\r\n]+", "%0A", url)
    fields |= {"WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{urn(refers_to)}>", "WARC-Profile": REVISIT}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, refers_to) as archives in ``folder``, a new one after ``archive_bytes``, and returns the manifest (path, records, bytes).

    Archives carry their task attempt in their name, and only those of attempts that
    succeeded are in the manifest, a table in the shared folder, so lost executors and
    repeated tasks leave no half-written or double records.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        attempt, made, archive = TaskContext.get().taskAttemptId(), [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if archive is None:
                    name = f"{base}/part-{TaskContext.get().partitionId():05d}-{attempt}-{len(made):04d}.zip"
                    archive = _Archive(store.open_output_stream(name))
                    made.append([f"{folder}/{name.rpartition('/')[2]}", archive])
                archive.add(row[0], record(row[0], row[1], row[2].encode(), row[3]))
                if archive.offset >= archive_bytes:
                    archive = archive.close()
        if archive:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), *[pa.array(x, pa.int64()) for x in ([len(a.lines) for _, a in made], [a.offset for _, a in made])]], ["path", "records", "bytes"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "manifest")


class _Archive:
    def __init__(self, out):
        self.out, self.zip, self.offset, self.lines = out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0, []
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{urn(page_id)} {DATE} " + json.dumps({"filename": DATA, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)) + "\n" * bool(self.lines))
        self.zip.close()
        self.out.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def central_directory(read, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes; ``read(offset, length)`` reads a range."""
    begin = max(0, size - 22 - 65535)
    tail = read(begin, size - begin)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    total, length, start = struct.unpack_from("<HII", tail, at + 10)
    if total == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(begin + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        total, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, out, p = read(start, length), [], 0
    for _ in range(total):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        field, end = p + 46 + n, p + 46 + n + extra
        while field + 4 <= end:
            kind, width = struct.unpack_from("<HH", directory, field)
            if kind == 1:  # what is too large for its place above, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", directory, field + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            field += 4 + width
        out.append(Member(name, method, packed, header))
        p = end + comment
    return out


def data_offset(read, member: Member) -> int:
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _reader(store, path: str):
    file = store.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        return file.read_at(length, offset)

    return read, file.size()


def locate_records(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record, from the archives' directories and indexes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                read, size = _reader(*filesystem(path))
                members = {m.name: m for m in central_directory(read, size) if m.method == 0}
                rows = []
                for m in members.values():
                    if m.name.startswith("indexes/"):
                        for line in read(data_offset(read, m), m.size).decode().splitlines():
                            place = json.loads(line.split(" ", 2)[2])
                            rows.append((place["filename"], place["offset"], place["length"]))
                begins = {n: data_offset(read, members[n]) for n in {r[0] for r in rows}}
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([begins[n] + o for n, o, _ in rows], pa.int64()), pa.array([k for _, _, k in rows], pa.int64())], ["path", "offset", "length"])

    return manifest.select("path").mapInArrow(run, "path string, offset long, length long")


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's header, its HTTP header and its payload."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def read_records(ranges: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (and html); a response whose payload does not have its digest is an error."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path not in files:
                    files.clear()
                    files[path] = _reader(*filesystem(path))[0]
                warc, http, payload = parse_record(gzip.decompress(files[path](offset, length)))
                sha1 = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                response = warc["WARC-Type"] == "response"
                if response and (digest(payload) != sha1 or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"broken record at {offset} of {path}")
                name = lambda key: page_of(warc[key][1:-1]) if key in warc else None
                rows.append((name("WARC-Record-ID"), int(http["Content-Length"]), sha1, warc["WARC-Type"], name("WARC-Refers-To"), *((payload.decode() if response else None,) if with_payload else ())))
            columns = list(zip(*rows, strict=True)) or [()] * (6 if with_payload else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if with_payload else [])]
    out = ranges.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", html string" * with_payload)
    return out.withColumns({c: F.expr(f"try_cast({c} as {id_type})") for c in ("page_id", "refers_to")})


#: Bytes of archives that a reading task is to take, about.
READ = 64 << 20


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 0) -> DataFrame:
    """``pages`` as (page_id, url, html, refers_to): of equal payloads of at least ``least`` bytes all but the least id's refer to that."""
    rows = pages.select(F.col(id_col).alias("page_id"), (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("url"), whole(html_col).alias("html"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    by_salt = keyed.where(F.octet_length("html") >= least).groupBy("key", "salt").agg(F.min("page_id").alias("first"))
    firsts = by_salt.groupBy("key").agg(F.min("first").alias("first"))
    found = by_salt.select("key", "salt").join(firsts, "key")
    joined = keyed.join(found, ["key", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archive_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 0, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes a record for each row of ``pages`` and reads all records back from the archives.

    Null payloads are empty, null addresses are left out of the record. Rows that repeat
    the least id of their payload are responses all; a null id is written as such, refers
    to the least id of its payload (if all are null, all are responses), and comes back
    as null. An empty table gives no rows. Columns not named are ignored.
    """
    folder = folder or fresh_path(spark, "archives")
    manifest = write_archives(mark_revisits(pages, id_col, html_col, url_col, least), folder)
    ranges = locate_records(manifest)
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // READ)
    id_type = dict(pages.dtypes)[id_col]
    return read_records(ranges.repartition(parts, "path", F.floor(F.col("offset") / (8 << 20))), id_type, with_payload).withColumnRenamed("page_id", id_col)
