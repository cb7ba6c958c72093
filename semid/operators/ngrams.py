"""N-grams of the fallback tokenizer's pieces, counted as numbers in blocks of text.

A piece has at most four bytes, so it is a 32-bit number. Pieces are counted first: an
n-gram is no more frequent than its pieces, so those that are too rare end it. The others,
at most 2,548,842 (all that the tokenizer can give), are numbered by frequency, and up to
three numbers make one 64-bit number, exactly. A block of texts sorts and counts its
numbers, cuts them by a hash of their first two pieces into buckets, and sends each as one
packed row; a bucket's rows are added up in one task. Buckets follow the number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Pieces that fit into one number.
LONGEST = 3
#: Bytes of text in a block, and pieces for each bucket.
BLOCK, BUCKET = 1 << 23, 2_000_000
SPACE, LOWER, UPPER, DIGIT, INNER, OTHER = range(6)
#: The kind of each byte; INNER are the bytes behind the first of a character.
KINDS = bytes(SPACE if chr(c) in " \t\n\x0b\f\r" else LOWER if 97 <= c <= 122 else UPPER if 65 <= c <= 90 else DIGIT if 48 <= c <= 57 else INNER if 128 <= c < 192 else OTHER for c in range(256))


def piece_codes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of texts that stand one behind the other in ``data`` and begin at ``starts``, as their bytes in one number each, and which of them are a text's first."""
    import numpy as np

    kind, edge = np.frombuffer(KINDS, np.uint8)[data], np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[edge[:-1]], after[edge[1:]] = SPACE, SPACE
    begins = (kind != before) | (kind == OTHER) | ((kind == UPPER) & (after == LOWER))
    begins &= (kind != INNER) & ~((kind == LOWER) & (before == UPPER))
    at = np.flatnonzero(begins | edge[:-1])
    size, of = np.diff(at, append=len(data)), kind[at]
    at, size = (x[(of != SPACE) & (of != INNER)] for x in (at, size))
    parts = (size + 3) // 4  # a run is cut into pieces of four
    nth = 4 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    at, size = np.repeat(at, parts) + nth, np.minimum(np.repeat(size, parts) - nth, 4)
    fours = np.ndarray(len(data), ">u4", np.append(data, np.zeros(4, np.uint8)), strides=(1,))
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, starts)] = True
    return fours[at].astype(np.uint32) & np.array([0, 0xFF000000, 0xFFFF0000, 0xFFFFFF00, 0xFFFFFFFF], np.uint32)[size], first[:-1]


def piece_texts(codes: np.ndarray) -> list[str]:
    """The pieces of ``piece_codes`` as texts; no bytes at all are the zero character."""
    return [x.decode("utf-8", "replace") or "\0" for x in codes.astype(">u4").view("S4").tolist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece codes and first pieces of the texts of all batches, about BLOCK bytes at once."""
    import numpy as np
    import pyarrow as pa

    kept, size = [], 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        texts = pa.concat_arrays(kept)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
        return piece_codes(data, offsets[:-1] - offsets[0])

    for batch in batches:
        texts = batch.column(0).drop_null().cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK - size, side="right")) - 1)
            kept.append(texts[i:j])
            size += int(ends[j] - ends[i])
            i = j
            if size >= BLOCK or i < len(texts):
                if size:
                    yield taken()
                kept, size = [], 0
    if size:
        yield taken()


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each stands, or the sum of its counts. Without counts, ``keys`` are sorted in place."""
    import numpy as np

    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, as differences, and counts, each by places of bytes, compressed."""
    import numpy as np
    import pyarrow as pa

    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (steps, counts.astype(np.uint32))]
    return pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import numpy as np
    import pyarrow as pa

    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(packed, 12 * n, asbytes=True), np.uint8).reshape(12, n)
    steps, counts = (np.ascontiguousarray(x.T).view(kind).ravel() for x, kind in ((planes[:8], np.uint64), (planes[8:], np.uint32)))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def frequent_grams(texts: DataFrame, text_col: str, sizes: tuple[int, ...], least: int) -> DataFrame:
    """(_size, _g0, _g1, _g2, frequency) of the n-grams of up to LONGEST pieces that are found ``least`` times or more within texts, pieces beyond the size being null.

    Left out are those whose pieces form an identifier: all letters, digits and underscores, and no digit first.
    """
    import numpy as np
    import pyarrow as pa

    spark, rows = texts.sparkSession, texts.select(text_col)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, _ in _blocks(batches):
            found, n = _counted(codes)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["piece", "n"])

    counts = rows.mapInArrow(pieces_of, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "piece").toArrow()  # all that the tokenizer can give, at most
    by_id, total = common["piece"].to_numpy().astype(np.uint32), sum(common["n"].to_numpy().tolist())
    none, buckets = len(by_id), 1 + total // BUCKET
    shared = spark.sparkContext.broadcast(by_id)

    def numbers() -> tuple[np.ndarray, ...]:
        """Codes in order, their numbers, and by number whether a piece is part of identifiers, and whether it begins with a digit."""
        order = np.argsort(shared.value)
        kinds = np.frombuffer(KINDS, np.uint8)[shared.value >> 24]
        within = (kinds < INNER) | (shared.value == ord("_") << 24)
        return shared.value[order], order.astype(np.uint64), np.append(within, False), np.append(kinds == DIGIT, False)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, number, within, digit = numbers()
        base = np.uint64(none + 1)
        for codes, first in _blocks(batches):
            at = np.minimum(np.searchsorted(ordered, codes), none - 1)
            known = ordered[at] == codes
            ids, keys = np.where(known, number[at], np.uint64(none)), []
            for n in sizes:
                m = max(0, len(ids) - n + 1)
                whole, name = known[:m].copy(), within[ids[:m]] & ~digit[ids[:m]]
                for j in range(1, n):
                    whole &= known[j : j + m] & ~first[j : j + m]
                    name &= within[ids[j : j + m]]
                begin, key = np.flatnonzero(whole & ~name), np.uint64(0)
                for j in range(LONGEST):
                    key = key * base + (ids[begin + j] if j < n else np.uint64(none))
                keys.append(key)
            keys, n = _counted(np.concatenate(keys))
            prefix = keys // base
            bucket = ((prefix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(ends[1:] > ends[:-1])
            packs = [_packed(keys[o], n[o]) for b in used for o in (order[ends[b] : ends[b + 1]],)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(ends[used + 1] - ends[used], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "n", "packed"])

    def added(packs: pa.Table) -> pa.Table:
        parts = [_unpacked(n, packed) for n, packed in zip(packs["n"].to_pylist(), packs["packed"].to_pylist(), strict=True)]
        keys, n = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        keys, n, base = keys[n >= least], n[n >= least], np.uint64(none + 1)
        ids = [keys // base**np.uint64(j) % base for j in reversed(range(LONGEST))]
        there = [x < none for x in ids]
        shown = [pa.array(piece_texts(np.append(shared.value, np.uint32(0))[x]), pa.string(), mask=~t) for x, t in zip(ids, there, strict=True)]
        return pa.table([pa.array(sum(t.astype(np.int32) for t in there), pa.int32()), *shown, pa.array(n, pa.int64())], names=["_size", *[f"_g{j}" for j in range(LONGEST)], "frequency"])

    columns = ", ".join(f"_g{j} string" for j in range(LONGEST))
    packs = rows.limit(0) if not none else rows
    return packs.mapInArrow(grams_of, "bucket int, n int, packed binary").groupBy("bucket").applyInArrow(added, f"_size int, {columns}, frequency bigint")
