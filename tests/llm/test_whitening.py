"""Whitening against NumPy over all vectors at once, in exact whole numbers where they are asked for."""

import math

import numpy as np
import pytest

from semid.llm.queries import QUERIES
from semid.llm.whitening import fit, identity_error, whiten


def brute(rows, components=32):
    """{id: deviation}, {id: projections}, shares of variance for (id, vector) rows."""
    ids = [i for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows if i in set(ids)], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = {i: int(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for i, r in zip(ids, x, strict=True)}
    centred = ((n * x - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return dev, dict(zip(ids, centred @ axes / np.sqrt(values), strict=True)), values / np.trace(centred.T @ centred / n)


def agree(got, rows, components):
    dev, proj, shares = brute(rows, components)
    assert {r["vec_id"] for r in got} == set(dev) and len(got) == len(dev) * components
    signs = {}
    for r in got:
        k = r["component"] - 1
        want = proj[r["vec_id"]][k]
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-6
        assert r["deviation"] == dev[r["vec_id"]] and r["n"] == len(dev)
        assert abs(r["explained"] / shares[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_equals_numpy(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op13_whitening"](spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    agree(got.collect(), rows, 32)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 1 + i % 3, 6).tolist()) for i in range(400)]
    return [*good, (900, None), (901, [None] * 6), (902, [1.0, None, 3.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0]), (906, []), (907, [1e30] + [0.0] * 5)]


def table(spark, rows, **extra):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, named int, deviation int")


def exploded(df, model, error):
    out = []
    for r in df.collect():
        out += [{"vec_id": r["vec_id"], "component": k + 1, "n": model.n, "deviation": r["deviation"], "whitened": w, "explained": model.explained[k], "identity_error": error} for k, w in enumerate(r["whitened"])]
    return out


def test_odd_vectors_are_left_out(spark, vectors):
    df = table(spark, vectors).repartition(5)
    model = fit(df)
    agree(exploded(whiten(df, model), model, identity_error(df, model)), vectors[:400], 6)
    assert whiten(df, model, carry=("named",)).columns == ["vec_id", "named", "deviation", "whitened"]


def test_repeated_null_and_equal_rows(spark, vectors):
    rows = [*vectors[:50], *[vectors[0]] * 30, (None, vectors[1][1])]
    df = table(spark, rows)
    model = fit(df)
    assert model.n == 81 and whiten(df, model).count() == 81 and identity_error(df, model) < 1e-9
    same = table(spark, [(i, [1.0, 2.0]) for i in range(9)])
    model = fit(same)
    assert model.explained == [] and identity_error(same, model) == 0.0
    assert [(r["deviation"], r["whitened"]) for r in whiten(same, model).collect()] == [(0, [])] * 9


def test_empty_table(spark):
    df = table(spark, [])
    model = fit(df)
    assert model.n == 0 and whiten(df, model).count() == 0 and identity_error(df, model) == 0.0
    odd = table(spark, [(1, None), (2, [])])
    assert whiten(odd, fit(odd)).count() == 0


def test_exact_where_64_bits_end(spark):
    big = [(0, [6e13, 0.0]), (1, [-6e13, 1.0]), (2, [0.0, 2.0]), (3, [2e6, 1e6])]
    df = table(spark, big)
    model = fit(df)
    want, _, _ = brute(big, 2)
    got = {r["vec_id"]: r["deviation"] for r in whiten(df, model).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()
    near = [(0, [4e6, 4e6]), (1, [-4e6, 1.0]), (2, [0.0, 2.0]), (3, [2e6, 1e6])]
    df = table(spark, near)
    got = {r["vec_id"]: r["deviation"] for r in whiten(df, fit(df)).collect()}
    assert got == brute(near, 2)[0]
