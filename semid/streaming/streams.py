"""Structured Streaming: windowed event counts, sessions, episodes' last states, mini-batch codebooks. These go beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semid.operators.quantize import minibatch_step


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window; works on streams (with a watermark) and tables alike."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return source.groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", by: str = "user_id") -> DataFrame:
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def wealth_deltas(steps: DataFrame) -> DataFrame:
    """(episode_id, step, delta) against the state before, across micro-batches; ``steps`` is (episode_id, step, wealth). A batch is taken in step order; a step older than the last one seen is left out as late."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            if last is None or r.step > last[0]:
                out.append((key[0], r.step, 0.0 if last is None else r.wealth - last[1]))
                last = (int(r.step), float(r.wealth))
        state.update(last)
        yield pd.DataFrame(out, columns=["episode_id", "step", "delta"])

    return steps.groupBy("episode_id").applyInPandasWithState(run, "episode_id string, step int, delta double", "step int, wealth double", "append", GroupStateTimeout.NoTimeout)


def idle_deltas(rows: DataFrame, key: str, ts: str, order: str, value: str, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, ts, order, delta): each row's ``value`` against the row before it of its key, by ``ts`` and ``order``; 0 for a key's first row and where more than ``idle_ms`` passed between both.

    A key's state, its last row, has a timer: once the watermark is ``idle_ms`` behind that
    row, no row that is on time can still be compared with it, and the state goes. So keys
    that fall silent cost nothing, and the result is the same as with states for ever. Rows
    behind the last one of their key are late and left out. The session needs the state store
    that ``stateful`` sets.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Deltas(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at bigint, ord bigint, value double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last, out = self.last.get() if self.last.exists() else None, []
            for r in pd.concat(list(rows)).sort_values(["at", "ord"]).itertuples():
                if last is None or (r.at, r.ord) > (last[0], last[1]):
                    out.append((key[0], r.at, r.ord, 0.0 if last is None or r.at - last[0] > idle_ms * 1000 else r.value - last[2]))
                    last = (int(r.at), int(r.ord), float(r.value))
            if last is not None:
                self.last.update(last)
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(last[0] // 1000 + idle_ms + 1)
            yield pd.DataFrame(out, columns=["key", "at", "ord", "delta"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            yield pd.DataFrame([], columns=["key", "at", "ord", "delta"])

        def close(self) -> None:
            pass

    kind = dict(rows.dtypes)[key]
    named = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).cast("bigint").alias("ord"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    out = named.groupBy("key").transformWithStateInPandas(Deltas(), f"key {kind}, at bigint, ord bigint, delta double", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("ord").alias(order), "delta")


def stateful(spark: SparkSession) -> None:
    """The state store that processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CodebookLearner:
    """Mini-batch k-means over a stream: pass ``update`` to ``foreachBatch``.

    Centroids and counts (K vectors) are written to ``path`` after each batch, under the
    batch's number, and read from there by a learner that starts later, which goes on with
    them. A batch whose number has been seen, as a restarted stream repeats its last one, changes nothing.
    """

    ROW = "code int, vec array<double>, n double"

    def __init__(self, spark: SparkSession, centroids: list[list[float]], path: str, vec_col: str = "vec"):
        self.spark, self.path, self.vec_col = spark, path, vec_col
        self.centroids, self.counts, self.epoch = centroids, [0.0] * len(centroids), -1
        if done := self.epochs():
            self.epoch = done[-1]
            rows = spark.read.schema(self.ROW).parquet(f"{path}/epoch={self.epoch}").orderBy("code").collect()  # K rows
            self.centroids, self.counts = [list(r["vec"]) for r in rows], [r["n"] for r in rows]

    def epochs(self) -> list[int]:
        """The batches whose results are whole."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def update(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.epoch:
            return
        self.centroids, self.counts = minibatch_step(batch, self.centroids, self.counts, self.vec_col)
        rows = [(i, [float(x) for x in c], float(n)) for i, (c, n) in enumerate(zip(self.centroids, self.counts, strict=True))]
        self.spark.createDataFrame(rows, self.ROW).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        self.epoch = epoch
