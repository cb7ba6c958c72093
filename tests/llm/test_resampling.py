"""Importance resampling against a plain version, text by text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD  # noqa: F401

from semid.llm import resampling
from semid.llm.queries import QUERIES
from semid.llm.resampling import features, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, runs=2):
    ws = WORD.findall((text or "").translate(FOLD))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, runs + 1) for i in range(len(ws) - k + 1)]


def bucket(gram, buckets=10_000):
    return zlib.crc32(gram.encode()) % buckets


def brute(docs, target, least=20, percent=25, seed=7):
    """{row: (n_features, weight, score, rank)} for (id, text) rows whose ids differ."""
    s, t = Counter(), Counter()
    for text in docs.values():
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out, enough = {}, []
    for i, text in docs.items():
        n, gs = grams(text)
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(gs), weight, score, None]
        if n >= least:
            enough.append(i)
    for place, i in enumerate(sorted(enough, key=lambda i: (-out[i][2], i is None, i))[: percent * len(enough) // 100], 1):
        out[i][3] = place
    return {i: tuple(v) for i, v in out.items()}


def rows_of(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def test_query_equals_plain_version(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, sf_dir)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert rows_of(got) == brute(docs, target)


@pytest.mark.parametrize("window", [7, 64, 1 << 22])
@pytest.mark.parametrize("runs", [1, 2, 3])
def test_features_of_any_bytes(monkeypatch, window, runs):
    monkeypatch.setattr(resampling, "WINDOW", window)
    rng = np.random.default_rng(3)
    alphabet = list("abZ09 .\n\x00é你\U0001f600-")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(80)] + ["", "x" * 300, "a " + "y" * 70 + " b", " ", "end"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = [Counter() for _ in texts]
    for _, text, b in features(offsets, memoryview(b"".join(data)), runs, 997):
        for i, x in zip(text.tolist(), b.tolist(), strict=True):
            got[i][x] += 1
    assert got == [Counter(bucket(g, 997) for g in grams(t, runs)[1]) for t in texts]


def test_odd_rows(odd, none, spark):
    target = spark.createDataFrame([("one two words",), (None,)], "text string")
    got = resample(odd, target, least_words=1, percent=100, carry=("n_words", "n"))
    assert got.columns[:3] == ["doc_id", "n_words", "n"] and got.count() == len(ODD)
    long_one = got.where("doc_id = 10").first()
    assert long_one["n_features"] == 60_000 + 59_999
    assert got.where("doc_id = 1").first()["weight"] == 0
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(grams(t)[0] > 0 for _, t in ODD)
    assert resample(none, target).count() == 0
    assert resample(odd, target.limit(0)).count() == len(ODD)


def test_repeated_rows_and_ties(spark):
    rows = spark.createDataFrame([(1, "same text")] * 500 + [(2, "same text"), (None, "same text")], "doc_id bigint, text string").repartition(7)
    got = resample(rows, rows, least_words=2, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 252))
    assert len({(r["doc_id"], r["score"]) for r in got}) == 3
