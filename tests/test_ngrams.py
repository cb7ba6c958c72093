"""N-grams counted as numbers, against brute force over the pieces of the tokenizer's pattern."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semid.functions import text as T
from semid.operators import ngrams
from semid.queries import QUERIES


def _texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "Bc", "DEF", "DEFg", "HIJKL", "mnopqr", "12", "34567", "_", "__x", ".", " ", "\n", "\x0b", "é", "中", "😀", " ", "\0", "Ġ", "-", "a_b", "ABCDEFGHi"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)] + ["", " ", "x", None, "Z", "aB", "B" * 9 + "b" * 9]


def _pieces(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["p"] or [] for r in df.orderBy("i").select(T.pieces(F.col("text")).alias("p")).collect()]


def test_pieces_as_numbers(spark):
    texts = _texts(400)
    raw = [(t or "").encode() for t in texts]
    codes, first = ngrams.piece_codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1])
    want = _pieces(spark, texts)
    assert ngrams.piece_texts(codes) == [x for p in want for x in p]
    assert first.tolist() == [i == 0 for p in want for i in range(len(p))]


@pytest.mark.parametrize(("sizes", "bucket"), [((2, 3), 2_000_000), ((2, 3), 300), ((1, 3), 50), ((2, 4), 300)])
def test_mined_ngrams(sizes, bucket, spark, monkeypatch):
    texts = _texts(700)
    monkeypatch.setattr(ngrams, "BUCKET", bucket)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    runs = Counter()
    for p in _pieces(spark, texts):
        runs.update(tuple(p[i : i + n]) for n in sizes for i in range(len(p) - n + 1))
    shown = spark.createDataFrame([(list(g), c) for g, c in runs.items() if c >= 4], "g array<string>, c bigint").select("c", F.size("g").alias("n"), T.surface(F.col("g")).alias("s")).collect()
    best = {}
    for r in shown:
        if len(r["s"]) >= 3 and not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", r["s"]):
            best[r["s"]] = max(best.get(r["s"], (0, 0)), (r["c"], r["n"]))
    got = {r["token"]: (r["frequency"], r["current_subtokens"]) for r in T.mine_ngrams(df, sizes=sizes, min_frequency=4).collect()}
    assert got == best and best


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_blocks_hold_every_text_once(most, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngrams, "BLOCK", most)
    texts = _texts(90)
    batches = [pa.record_batch([pa.array(x, pa.string())], names=["text"]) for x in (texts[:50], [], [None, ""], texts[50:])]
    blocks = list(ngrams._blocks(iter(batches)))
    raw = [(t or "").encode() for t in texts]
    codes, first = ngrams.piece_codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1])
    assert np.concatenate([c for c, _ in blocks]).tolist() == codes.tolist() and np.concatenate([f for _, f in blocks]).tolist() == first.tolist()
    assert len(blocks) == 1 or most < 10_000


def test_no_ngram_is_a_row_before_it_is_counted(spark, sf_dir):
    plan = T.mine_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_no_frequent_pieces(spark):
    assert T.mine_ngrams(spark.createDataFrame([("a b, c",), (None,)], "text string")).count() == 0


@pytest.mark.parametrize("name", ["candidates_merge_v", "candidates_merge_r"])
def test_merged_candidates_shuffle_few_rows(name, spark, sf_dir):
    """Far fewer rows than there are different n-grams."""
    sc, none = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    assert QUERIES[name](spark, sf_dir).count() == 2
    rows = sum(n for k, n in shuffled().items() if k not in before)
    grams = {tuple(p[i : i + n]) for p in _pieces(spark, [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]) for n in (2, 3) for i in range(len(p) - n + 1)}
    assert 0 < rows < len(grams) / 2, (rows, len(grams))
