"""Completion scores and encodings against plain definitions."""

import math
import random

from semid.operators import evaluation as E
from semid.queries import QUERIES


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length_by_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 30))) for _ in range(2))
        assert E.common_length(a, b) == _common(a, b)
    assert E.edit_ratio("", "") == 1.0 and E.edit_ratio("a", "") == 0.0 and E.edit_ratio("abcd", "abed") == 0.75


def test_bleu_by_hand():
    assert E.sentence_bleu("a b c d e", "a b c d e") == 1.0 and E.sentence_bleu("x y", "a b") == E.sentence_bleu("", "a") == 0.0
    # unigrams 3/4, bigrams 1/3, no trigrams of 2 (1/4), no 4-grams of 1 (1/4)
    assert abs(E.sentence_bleu("a b x d", "a b c d") - (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25) < 1e-12
    assert abs(E.sentence_bleu("a b", "a b c d") - math.exp(-1)) < 1e-12
    assert E.bleu_tokens("It's 3.5-4, &amp; done.") == ["It's", "3.5", "-", "4", ",", "&", "done", "."]


def test_completion_scores(spark):
    rows = [(1, "x = ", " a b ", "a b", "python"), (2, "x = ", "(", "(", "python"), (3, "", "", None, "go"), (4, None, None, "a", None), (5, "", "x\n", "y", "go")]
    df = spark.createDataFrame(rows, "id int, prompt string, predicted string, reference string, language string")
    got = {r["id"]: r for r in E.completion_scores(df).collect()}
    assert [got[i]["exact_match"] for i in range(1, 6)] == [1, 1, 1, 0, 0] and [got[i]["syntax_valid"] for i in range(1, 6)] == [0, 0, 0, 0, 1]
    means = E.completion_means(E.completion_scores(df)).first()
    assert means["num_samples"] == 5 and means["exact_match"] == 0.6 and E.completion_means(E.completion_scores(df.where("id > 9"))).first()["bleu"] == 0


def test_completion_query_by_brute_force(spark, sf_dir):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {r["id"]: r for r in QUERIES["exact_match_edit_ratio"](spark, sf_dir).collect()}
    want = {f"{c}/{t}": (turns[c, t], turns[c, t - 1]) for c, t in turns if (c, t - 1) in turns}
    assert set(got) == set(want)
    for i, (p, r) in want.items():
        assert abs(got[i]["edit_ratio"] - (2 * _common(p, r) / (len(p) + len(r)) if p + r else 1)) < 1e-6 and got[i]["exact_match"] == (p.strip() == r.strip())


def test_text_to_ids_by_the_library(spark, sf_dir):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in QUERIES["text_to_ids"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids[:128]
        assert got[r["doc_id"]]["n"] == len(ids) and got[r["doc_id"]]["length"] == 128
        assert got[r["doc_id"]]["ids"] == hashlib.md5(",".join(map(str, ids + [0] * (128 - len(ids)))).encode()).hexdigest()


def test_feed_forward_squeeze_and_losses_of_odd_rows(spark):
    import pytest
    from pyspark.sql import functions as F

    from semid.functions import vectors as V
    from semid.operators import encoding, retrieval, sampling

    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, None), (2, None), (3, [0.0, 0.0])], "id int, vec array<double>")
    net = [([[1.0, -1.0], [0.0, 1.0]], [0.5, 0.0]), ([[2.0], [3.0]], [-1.0])]
    got = [(r["id"], r["scores"]) for r in encoding.feed_forward(df, "vec", net).orderBy("id").collect()]
    assert got == [(1, [2.0]), (2, None), (2, None), (3, [0.0])] and encoding.feed_forward(df.where("id > 9"), "vec", net).count() == 0
    shapes = spark.createDataFrame([([[1.0], [2.0]],), ([[1.0, 2.0]],), ([[5.0]],), ([],)], "v array<array<double>>")
    assert [r[0] for r in shapes.select(V.squeeze(F.col("v"))).collect()] == [[1.0, 2.0], [1.0, 2.0], [5.0], []]
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "v array<array<double>>").select(V.squeeze(F.col("v"))).collect()
    keys = df.where("vec is not null").select(F.col("id").alias("key_id"), "vec")
    asked = spark.createDataFrame([(1, 1, [100.0, 900.0]), (2, 7, [1.0, 1.0])], "query_id int, label int, vec array<double>")
    want = {1: 1700.0}  # scores -1700 and 0; the label 7 has no vector
    assert {r["query_id"]: round(r["loss"], 9) for r in retrieval.full_cross_entropy(asked, keys, normalize=False, query_block=1, key_block=1).collect()} == want
    assert sampling.top_half(df.limit(0), "id", "id").count() == 0 and {r["id"] for r in sampling.top_half(df.where("id <> 2"), "id", "id").collect()} == {3}
