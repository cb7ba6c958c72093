"""Streams that stop and go on: states with timers, and a learner whose codebook outlives it."""

import random

import pytest
from pyspark.sql import functions as F

from semid.streaming import streams


def _run(spark, stream, path):
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()


def test_deltas_over_restarts_and_idle_keys(spark, tmp_path):
    streams.stateful(spark)
    rng, rows, at = random.Random(6), [], 0
    for i in range(300):
        at += rng.choice([60, 600, 5000]) * 1_000_000
        rows.append((rng.randrange(4), at, i, float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "k bigint, at bigint, n bigint, v double").select("k", F.timestamp_micros("at").alias("ts"), "n", "v")
    stream = lambda: streams.idle_deltas(streams.event_stream(spark, f"{tmp_path}/in", df.schema, 1), "k", "ts", "n", "v", idle_ms=6_000_000, late="10 minutes")
    for part in range(6):  # each time another query goes on where the last one stopped
        df.where(F.col("n").between(part * 50, part * 50 + 49)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        _run(spark, stream(), tmp_path)
    last, want = {}, {}
    for k, at, n, v in rows:
        before = last.get(k)
        want[n] = 0.0 if before is None or at - before[0] > 6_000_000_000 else v - before[1]
        last[k] = (at, v)
    got = {r["n"]: r["delta"] for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == want


def test_a_codebook_outlives_its_learner(spark, tmp_path):
    rng = random.Random(7)
    parts = [[(i, [rng.random(), rng.random()]) for i in range(20)] for _ in range(5)]
    start = [[0.1, 0.1], [0.9, 0.9], [0.1, 0.9]]
    frames = [spark.createDataFrame(p, "id bigint, vec array<double>") for p in parts]
    one = streams.CodebookLearner(spark, start, f"{tmp_path}/one")
    for epoch, df in enumerate(frames):
        one.update(df, epoch)
    for epoch, df in enumerate(frames):
        other = streams.CodebookLearner(spark, start, f"{tmp_path}/two")
        other.update(df, epoch)
        streams.CodebookLearner(spark, start, f"{tmp_path}/two").update(df, epoch)  # the last batch again
    again = streams.CodebookLearner(spark, start, f"{tmp_path}/two")
    assert again.epoch == 4 and again.counts == one.counts and again.centroids == one.centroids
    assert sum(again.counts) == 100


def test_a_stopped_stream_goes_on(spark, tmp_path):
    rng = random.Random(9)
    for p in range(4):
        spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(30)], "id bigint, vec array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = [[0.2, 0.2], [0.8, 0.8]]

    def run(name, most=None):
        learner = streams.CodebookLearner(spark, start, f"{tmp_path}/{name}")

        def update(batch, epoch):
            if most is not None and epoch >= most:
                raise RuntimeError("stopped here")
            learner.update(batch, epoch)

        source = streams.event_stream(spark, f"{tmp_path}/in", "id bigint, vec array<double>", 1)
        source.writeStream.foreachBatch(update).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()

    run("whole")
    with pytest.raises(Exception, match="stopped here"):
        run("halves", most=2)
    run("halves")
    a, b = (streams.CodebookLearner(spark, start, f"{tmp_path}/{n}") for n in ("whole", "halves"))
    assert (a.epoch, a.counts, a.centroids) == (b.epoch, b.counts, b.centroids) == (3, b.counts, b.centroids)
