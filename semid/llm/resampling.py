"""Target-distribution importance resampling over hashed n-gram features.

Features are runs of words, hashed into buckets. Two passes in Arrow batches:

1. each task adds up its features by ``np.bincount`` into one vector of bucket
   counts, and ``treeReduce`` merges the vectors of all tasks (one of the corpus,
   one of the target texts). Their log ratio is a bucket's gain;
2. the gains are broadcast (a vector of fixed length) and gathered for every
   feature; ``np.bincount`` with the gains as weights sums them up by document.

A document's weight is the mean of its gains. Weights and keyed Gumbel noise give
scores, and the highest scores are a draw without replacement in which a document's
chance follows its weight. Ranks are those of the whole table, worked out in ranges.

Words and their hashes are found for whole batches at once: every byte of a
multi-byte character is a word's byte, so bytes decide where words end, and the
checksum of a run of words goes on where that of the words before it stopped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.operators.sampling import placed

from .common import whole, written

#: Bytes that are looked at together; a longer text is cut behind a word.
WINDOW = 1 << 22
#: Words longer than this are hashed one by one.
LONG = 64
ONES = 0xFFFFFFFF
#: A-Z become a-z, bytes that belong to no word become a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def crc_table() -> np.ndarray:
    """What the checksum's polynomial leaves of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


TABLE = crc_table()


class Words:
    """The words of a run of folded bytes, longest first for hashing."""

    def __init__(self, data: bytes, cuts: np.ndarray):
        """``cuts``: where texts begin; no word reaches across."""
        self.data, self.bytes = data, np.frombuffer(data, np.uint8)
        held = self.bytes != 32
        before, behind = np.zeros_like(held), np.zeros_like(held)
        before[1:], behind[:-1] = held[:-1], held[1:]
        before[cuts[cuts < len(held)]] = False
        behind[cuts[(cuts > 0) & (cuts <= len(held))] - 1] = False
        self.start = np.flatnonzero(held & ~before)
        self.length = np.flatnonzero(held & ~behind) + 1 - self.start
        self.order = np.argsort(-np.minimum(self.length, LONG + 1).astype(np.int16), kind="stable")
        self.longer = len(self.start) - np.cumsum(np.bincount(np.minimum(self.length, LONG + 1), minlength=LONG + 2))

    def hashed(self, state: np.ndarray) -> np.ndarray:
        """Each word's checksum, going on from ``state``."""
        first, out = int(self.longer[LONG]), state[self.order]
        start = self.start[self.order]
        for i in range(first):
            at, n = int(start[i]), int(self.length[self.order[i]])
            out[i] = zlib.crc32(memoryview(self.data)[at : at + n], int(out[i]) ^ ONES) ^ ONES
        for k in range(LONG):
            n = int(self.longer[k])
            if n <= first:
                break
            now = out[first:n]
            out[first:n] = TABLE[(now ^ self.bytes[start[first:n] + k]) & 255] ^ (now >> 8)
        back = np.empty_like(out)
        back[self.order] = out
        return back


def pieces(offsets: np.ndarray, data: memoryview) -> Iterator[tuple[int, int, int, bytes]]:
    """(first text, text behind the last, where the piece begins, its folded bytes): whole texts of up to ``WINDOW`` bytes together, or parts of a longer one."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + WINDOW, "right")) - 1)
        begin, stop = int(offsets[k]), int(offsets[end])
        while stop - begin > WINDOW:  # one long text
            cut = begin + WINDOW
            while cut < stop and FOLDED[data[cut]] != 32:
                cut += 1
            yield k, end, begin, bytes(data[begin:cut]).translate(FOLDED)
            begin = cut
        yield k, end, begin, bytes(data[begin:stop]).translate(FOLDED)
        k = end


def features(offsets: np.ndarray, data: memoryview, runs: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a run, texts, buckets) for the features of each piece."""
    tail: list[np.ndarray] = []  # of a cut text: the checksums of the runs that end with its last word
    for first, end, begin, folded in pieces(offsets, data):
        if begin == offsets[first]:
            tail = []
        words = Words(folded, np.maximum(offsets[first:end] - begin, 0))
        if not len(words.start):
            continue
        text = first + np.searchsorted(offsets[first : end + 1] - begin, words.start, "right") - 1 if end - first > 1 else np.full(len(words.start), first)
        state, keep, last = np.full(len(text), ONES, np.uint32), np.ones(len(text), bool), []
        for size in range(1, runs + 1):
            if size > 1:  # words that have a run of size - 1 words before them in their text
                moved = np.concatenate([tail[size - 2] if len(tail) > size - 2 else np.zeros(1, np.uint32), state[:-1]])
                same = np.concatenate([[len(tail) > size - 2], text[1:] == text[:-1]])
                keep = np.concatenate([[True], keep[:-1]]) & same
                state = TABLE[(moved ^ 32) & 255] ^ (moved >> 8)
            state = words.hashed(state)
            last.append(state[-1:] if keep[-1] else None)
            yield size, text[keep], ((state[keep] ^ np.uint32(ONES)) % np.uint32(buckets)).astype(np.int64)
        tail = [x for x in last if x is not None]


def _texts(column) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of an Arrow column of binary values."""
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64), memoryview(data) if data else memoryview(b"")


class Counts(NamedTuple):
    buckets: np.ndarray
    texts: int  # of enough words


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int, least_words: int) -> Counts:
    """First pass: features of all texts by bucket, and the number of texts of ``least_words`` words or more."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            offsets, data = _texts(batch.column(0))
            n_words = np.zeros(len(offsets) - 1, np.int64)
            for size, text, bucket in features(offsets, data, runs, buckets):
                total[:-1] += np.bincount(bucket, minlength=buckets)
                if size == 1:
                    n_words += np.bincount(text, minlength=len(n_words))
            total[-1] += np.count_nonzero(n_words >= least_words)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = texts.select(whole(text_col).cast("binary").alias("text")).mapInArrow(count, "v binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    total = vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets + 1, np.int64)
    return Counts(total[:-1], int(total[-1]))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's log ratio of target to source, one added to every count."""
    all_s, all_t, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, runs: int, carry: tuple[str, ...]) -> DataFrame:
    """Second pass, per row: named (a struct of its id and the ``carry`` columns), n_words, n_features, weight."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            offsets, data = _texts(batch.column("text"))
            n = len(offsets) - 1
            n_words, n_features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for size, text, bucket in features(offsets, data, runs, len(gain)):
                here = np.bincount(text, minlength=n)
                n_features += here
                total += np.bincount(text, weights=gain[bucket], minlength=n)  # whole numbers: exact
                if size == 1:
                    n_words += here
            weight = total.astype(np.int64) // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column("named"), *map(pa.array, (n_words, n_features, weight))], ["named", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*[F.col(c) for c in dict.fromkeys((id_col, *carry))]).alias("named"), whole(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"named {dict(rows.dtypes)['named']}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, by a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", runs: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: its id, the ``carry`` columns, n_features, weight, score and rank.

    Of the rows of ``least_words`` words or more, ``percent`` in a hundred (rounded down)
    are drawn: those of the highest scores, ties to the smaller id. ``rank`` counts them
    from 1 and is null for all others. Null and empty texts have no features and weight 0;
    a null id is hashed as an empty one and comes behind others of its score; repeated
    rows have equal scores and ranks of their own; an empty table gives no rows; an empty
    target weighs every bucket as if it had been seen once. Other columns are ignored,
    whatever their names.
    """
    source = bucket_counts(docs, text_col, runs, buckets, least_words)
    gain = gains(source.buckets, bucket_counts(target, target_col, runs, buckets, least_words).buckets)
    rows = weighed(docs, gain, id_col, text_col, runs, carry)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("named")[id_col], seed)).withColumn("enough", F.col("n_words") >= least_words)
    ranked = placed(written(rows, "weights"), [F.desc("enough"), F.desc("score"), F.asc_nulls_last(F.col("named")[id_col])], "rank")
    drawn = F.col("enough") & (F.col("rank") <= source.texts * percent // 100)
    return ranked.select(*[F.col("named")[c].alias(c) for c in dict.fromkeys((id_col, *carry))], "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
