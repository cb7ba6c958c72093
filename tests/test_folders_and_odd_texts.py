"""Tables that are folders of files, and odd rows, against SQL over the same tables."""

import math
import random
from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from semid.operators import graphs, sampling
from semid.plans import text_queries
from semid.queries import ORACLES, QUERIES


def _rows(spark, path, name):
    """A query's rows and its SQL's, columns in order of their names, both sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for folder in path.iterdir():
        con.execute(f"CREATE VIEW {folder.name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/*.parquet'")
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    df = QUERIES[name](spark, str(path))
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = [{n: plain(v) for n, v in zip(names, row, strict=True)} for row in rel.fetchall()]
    got = [{n: plain(r[n]) for n in df.columns} for r in df.collect()]
    return [sorted(repr(sorted(r.items())) for r in x) for x in (got, want)]


@pytest.mark.parametrize("name", ["stream_codebook", "stream_event_windows", "stream_idle_deltas", "stream_wealth_deltas"])
def test_streams_over_folders(name, spark, sf_dir, tmp_path):
    t = "embeddings" if name == "stream_codebook" else "events"
    spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = _rows(spark, tmp_path, name)
    assert got == want and got


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_ratios_of_texts_without_pieces(large, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_queries, "ranked", partial(sampling.ranked, large=large))
    texts = [(1, "a b c d", "x"), (2, "", "x"), (3, "hello world", "x"), (4, None, "x"), (5, " \n", "y"), (6, "abcdefgh i", None), (7, None, "z"), (8, "aa bbbbb", "x"), (10, "a", "y")]
    texts += [(100 + i, "word " * i + "x" * i, "many") for i in range(60)]
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _rows(spark, tmp_path, "ratio_percentiles")
    assert got == want and len(got) == 5


def test_smoothing_over_groups_equals_the_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(90)) for _ in range(400)] + [(100, i) for i in range(30)] * 2 + [(101, 7), (101, 7), (102, 7), (102, 95), (None, 3), (103, None), (103, 4), (103, 5), (104, 96), (104, 97)]
    pairs = spark.createDataFrame(pairs, "g bigint, i bigint").repartition(4)
    codes = spark.createDataFrame([(i, i % 7) for i in range(97) if i % 10], "key bigint, code bigint")
    book = spark.createDataFrame([(c, [rng.uniform(-1, 1) for _ in range(3)]) for c in range(6)], "code bigint, vec array<double>")
    got = {r["key"]: r["vec"] for r in graphs.smooth_groups(pairs, "g", "i", codes, book, 0.3, 2, 12).collect()}
    want = {r["key"]: r["vec"] for r in graphs.smooth(codes.join(book, "code").select("key", "vec"), graphs.cooccurrence_graph(pairs.where("g is not null"), "g", "i", 2, 12), 3, 0.3).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-12 for k in got for a, b in zip(got[k], want[k], strict=True))
    assert 96 in got and 69 not in got  # no vector has the code 6


def test_smoothing_shuffles_no_edges(spark, sf_dir):
    plan = QUERIES["cochange_smooth"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
