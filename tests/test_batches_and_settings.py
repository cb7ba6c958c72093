"""Collated batches, ranks in parts, pruned search and nested settings against plain versions."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semid.operators import batches as B
from semid.operators import retrieval as R
from semid.operators import sampling as T
from semid.operators import settings as C


def _md5(key, seed=42):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


def test_batches_are_of_near_length(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50) for _ in range(rng.randrange(30))] if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "user bigint, seq array<bigint>")
    got = B.collated(df, "user", ["seq"], batch_rows=16, length=20, pad=-1, oov=7).collect()
    clean = {i: [x for x in s or [] if x != 7][-20:] for i, s in rows}
    order = sorted(clean, key=lambda i: (len(clean[i]), _md5(i), i))
    assert [i for r in sorted(got, key=lambda r: r["batch_id"]) for i in r["keys"]] == order
    for r in got:
        assert r["width"] == max(len(clean[i]) for i in r["keys"])
        for i, s, m in zip(r["keys"], r["seq"], r["mask"], strict=True):
            n = len(clean[i])
            assert s == clean[i] + [-1] * (r["width"] - n) and m == [1] * n + [0] * (r["width"] - n)
    padded = sum(r["width"] - len(clean[i]) for r in got for i in r["keys"])
    assert padded < 20 * 16
    assert B.collated(df.limit(0), "user", ["seq"], 4, 5).count() == 0


def test_batches_with_labels_and_items(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [5, 6, 7])], "user bigint, seq array<bigint>")
    r = B.collated(df, "user", ["seq"], 4, 10, labels={"seq": ("next_k", {"k": 1, "mask_token": 99})}).first()
    assert (r["keys"], r["seq"], r["seq_labels"]) == ([2, 1], [[5, 6, 99, 0], [1, 2, 3, 99]], [[7], [4]])
    r = B.collated(df, "user", ["seq"], 4, 10, labels={"seq": ("shifted", {})}).first()
    assert (r["seq"], r["seq_labels"]) == ([[5, 6, 0], [1, 2, 3]], [[6, 7], [2, 3, 4]])
    items = spark.createDataFrame([(i, [float(i)], f"t{i}") for i in range(5)], "id bigint, vec array<double>, name string")
    got = B.stacked(items, "id", {"vec": "embedding", "name": "text"}, 2).collect()
    order = sorted(range(5), key=lambda i: (_md5(i), i))
    assert [r["keys"] for r in sorted(got, key=lambda r: r["batch_id"])] == [order[:2], order[2:4], order[4:]]
    assert all(r["text"] == [f"t{i}" for i in r["keys"]] and r["embedding"] == [[float(i)] for i in r["keys"]] for r in got)


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_ranks_of_small_and_large_groups(spark, large):
    rng = random.Random(5)
    rows = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"g{rng.randrange(60)}", rng.randrange(4)) for i in range(600)]
    got = T.ranked(spark.createDataFrame(rows, "id bigint, g string, x int").repartition(7), "g", [F.desc("x"), "id"], "r", large=large).collect()
    want = {}
    for g in {g for _, g, _ in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: (k, len(own)) for k, r in enumerate(own, 1)}
    assert {r["id"]: (r["r"], r["r_n"]) for r in got} == want and len(got) == len(rows)


def _full(queries, keys, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in keys))
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("probes", [0, 1, 3])
def test_pruned_search_equals_the_full_scan(spark, probes):
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:6] * 50
    x = [(i, (centres[i % 6] + rng.normal(0, 1, 8)).round(1).tolist()) for i in range(900)]
    x += [(2000 + i, x[3][1]) for i in range(40)]  # equal keys: ties
    keys = spark.createDataFrame(x, "key_id bigint, vec array<double>")
    asked = [(i, v) for i, v in x if i % 50 == 0]
    queries = spark.createDataFrame(asked, "query_id bigint, vec array<double>")
    got = R.top_k_pruned(queries, keys, 7, centres.tolist(), query_block=4, key_block=32, probes=probes)
    plain = R.top_k_by_dot(queries, keys, 7)
    assert sorted(map(tuple, got.top.collect())) == sorted(map(tuple, plain.collect()))
    shares = got.blocks.first()
    assert shares["pairs"] > 0 and (shares["skipped"] > shares["pairs"] / 2 if probes else shares["skipped"] == 0)
    none = R.top_k_pruned(queries.limit(0), keys, 7, centres.tolist())
    assert none.top.count() == 0 and R.top_k_pruned(queries, keys.limit(0), 7, centres.tolist()).top.count() == 0
    few = R.top_k_pruned(queries, keys.where("key_id < 5"), 7, centres.tolist())
    assert few.top.count() == 5 * len(asked)


def _merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _random_doc(rng, depth=0):
    kinds = ["dict"] * (3 - depth) + ["int", "text", "list", "empty", "null"]
    kind = rng.choice(kinds)
    if kind == "dict" or depth == 0:
        return {k: _random_doc(rng, depth + 1) for k in rng.sample(["a", "b", "c.d", 'q"', "é"], rng.randrange(0, 4))}
    return {"int": rng.randrange(5), "text": rng.choice(["", "x y", 'q"\\'] ), "list": [1, {"z": 2}], "empty": {}, "null": None}[kind]


def test_deep_merges_of_random_documents(spark):
    rng = random.Random(8)
    docs = {i: [_random_doc(rng) for _ in range(3)] for i in range(120)}
    rows = [(i, level, json.dumps(d)) for i, ds in docs.items() for level, d in enumerate(ds)] + [(999, 0, None)]
    df = spark.createDataFrame(rows, "id bigint, level int, text string").select("id", "level", F.parse_json("text").alias("doc"))
    got = {r["id"]: json.loads(r["j"]) for r in C.deep_merge(df).select("id", F.to_json("doc").alias("j")).collect()}
    for i, (a, b, c) in docs.items():
        assert got.get(i, {}) == _merge(_merge(a, b), c), docs[i]
    assert 999 not in got


def test_overrides_and_reads(spark):
    df = spark.createDataFrame([(1, 0, '{"a": {"b": 1, "c": {"d": 2}}, "x": "y"}')], "id bigint, level int, text string").select("id", "level", F.parse_json("text").alias("doc"))
    changes = spark.createDataFrame([(1, "a.c=5", 0), (1, "a.n.m=word here", 1), (1, 'x={"k": 1}', 2), (1, "x.l=2", 3), (1, "e=", 4), (1, "a.b==", 5)], "id bigint, override string, n int")
    doc = C.deep_merge(df, changes=changes).first()["doc"].toPython()
    assert doc == {"a": {"b": "=", "c": 5, "n": {"m": "word here"}}, "x": {"k": 1, "l": 2}, "e": ""}
    r = df.select(C.read(F.col("doc"), "a.c.d", "int").alias("d"), C.read(F.col("doc"), "a.z", "int", 9).alias("z"), C.read(F.col("doc"), "x.q").alias("q")).first()
    assert (r["d"], r["z"], r["q"]) == (2, 9, None)
    with pytest.raises(Exception, match="key=value"):
        C.overrides(spark.createDataFrame([(1, "none", 0)], "id bigint, override string, n int")).collect()


def test_formulas(spark):
    from semid.functions.formulas import either, formula

    df = spark.createDataFrame([(5, None)], "x bigint, y bigint")
    got = df.select(formula("2^6"), formula("1 + 2*3**4 / (5 + -6)"), formula(" x ** 2 - x^3 "), formula("-(x + y)"), either(F.col("y") > 1, F.lit("a"), F.lit("b"))).first()
    assert list(got) == [4, -161.0, (25 - 5) ^ 3, None, "b"]
    for bad in ("1 +", "x.y", "f(1)", "x if 1 else 2", "1.5", "'a'", "x // 2", "~x", "", "True", "[1]"):
        with pytest.raises(ValueError):
            formula(bad)


def test_deep_merges_keep_digits_and_read_in_order(spark):
    rows = [(1, i, json.dumps({"n": i, "deep": {f"k{i % 3}": i, "e": {}}})) for i in range(200)]
    rows += [(2, 0, '{"a": 12345678901234567890123456789012345678, "b": 0.1234567890123456789012345678, "c": [1.10, {"d": 1e300}], "e": {"f": 1}, "g": 5}')]
    rows += [(2, 1, '{"e": {}, "g": {}}'), (3, 0, "{}"), (4, 0, "[1, 2]"), (None, 0, '{"a": 1}'), (5, 0, '{"a": {}}'), (5, 0, '{"a": 7}'), (5, 0, '{"a": 12}')]
    df = spark.createDataFrame(rows, "id bigint, level int, text string").repartition(5).select("id", "level", F.parse_json("text").alias("doc"))
    changes = spark.createDataFrame([(5, 'x={"k": {"l": 1}}', 3), (5, "x.m.n=2", 3), (5, 'x={"gone": 1}', 2), (6, 'y.z={"é": "😀"}', 0)], "id bigint, override string, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = C.deep_merge(df, changes=changes)
        got = {r["id"]: r["text"] for r in out.select("id", F.to_json("doc").alias("text")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert got[1] == '{"deep":{"e":{},"k0":198,"k1":199,"k2":197},"n":199}'
    assert got[2] == '{"a":12345678901234567890123456789012345678,"b":0.1234567890123456789012345678,"c":[1.1,{"d":1.0E300}],"e":{"f":1},"g":{}}'
    assert got[4] == "[1,2]" and got[5] == '{"a":7,"x":{"k":{"l":1},"m":{"n":2}}}' and got[6] == '{"y":{"z":{"é":"😀"}}}' and set(got) == {1, 2, 4, 5, 6}
