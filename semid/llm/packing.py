"""Packing token sequences by minimum bin slack.

Documents longer than a window are cut into full windows and a remainder. The
remainders' histogram, at most a window's length of counts, is all that the
driver plans with: starting from the longest remaining length, a subset-sum
dynamic program over a bitset finds the multiset of lengths that fills a window
closest to its capacity, the counts are traced back, and that pattern is used as
often as the counts allow. Pieces find their place by their rank among pieces of
their length, which is worked out in hash buckets, so that a very frequent
length is not ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytepairs import chunk_encoder
from .common import whole, written

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def padding(fill: int, window: int) -> int:
    """What a sequence is padded with: nothing at a power of two, else up to the window."""
    return 0 if fill & (fill - 1) == 0 else window - fill


def best_pattern(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of available lengths, with the longest among them, of the least padding, then the fullest."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    reach, before = 1 << lengths[0], []
    all_bits = (1 << (window + 1)) - 1
    for i, n in enumerate(lengths):
        before.append((n, reach))
        for _ in range(min(counts[n] - (i == 0), window // n)):
            more = (reach | reach << n) & all_bits
            if more == reach:
                break
            reach = more
        if reach >> window & 1:
            break
    fill = min((f for f in range(lengths[0], window + 1) if reach >> f & 1), key=lambda f: (padding(f, window), -f))
    pattern = {lengths[0]: 1}
    for n, held in reversed(before):
        while not held >> fill & 1:
            fill -= n
            pattern[n] = pattern.get(n, 0) + 1
    return pattern


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lowest rank, next rank, copies in a sequence, offset of the first, first sequence) for all of ``histogram``.

    Each pattern uses up one length at least, so there are no more patterns than lengths.
    """
    left, ranks, sequence, out = dict(histogram), dict.fromkeys(histogram, 0), 0, []
    while any(left.values()):
        pattern = best_pattern(left, window)
        times, offset = min(left[n] // c for n, c in pattern.items()), 0
        for n, c in sorted(pattern.items(), reverse=True):
            out.append((n, ranks[n], ranks[n] + times * c, c, offset, sequence))
            offset += n * c
            ranks[n] += times * c
            left[n] -= times * c
        sequence += times
    return out


def pieces(docs: DataFrame, json_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's ids and ``end_id``, cut at multiples of ``window``: id, start, length, checksum, tokens of the document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(json_file, pattern), end_id.to_bytes(4, "little")
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    at.append(k)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {PIECES}")


def pack(docs: DataFrame, json_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of the end id. Repeated rows and null ids are
    packed like others; an empty table gives no pieces. Columns not named are ignored.
    """
    spark = docs.sparkSession
    parts = written(pieces(docs, json_file, pattern, id_col, text_col, window, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # window rows at most
    buckets = max(64, sum(histogram.values()) // 1_000_000)
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = parts.withColumn("rank", F.row_number().over(within) - 1).join(begins, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("begin"))
    places = spark.createDataFrame(plan(histogram, window), "l long, lo long, hi long, copies long, first long, seq long")
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    behind = F.col("rank") - F.col("lo")
    return found.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq") + F.floor(behind / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first") + F.pmod(behind, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
