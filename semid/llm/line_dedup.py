"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (128-bit hash, number of documents), bucketed and sorted by
hash, and no two runs hold the same hash. Each batch of documents is merge-anti-joined
with the runs: the hashes that none of them holds become the batch's own run; the
batch's other hashes, seen before, go to a ledger with their counts. Most lines occur
in one document only, so the ledger is small. ``fanout`` runs of a level are merged
into one of the next, so a hash is rewritten only as often as there are levels. A
hash's number of documents is its run's count and the ledger's. All runs have the same
buckets, so that anti-joins, merges and the final join move none of them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, fresh_path, let, row_key, whole, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


RUN = "hash binary, docs long"
#: Lines of a whole corpus that a bucket is to take, about.
BUCKET = 8_000_000


class LineRuns:
    """Runs by level and the ledger. ``state`` names their folders and is all that must be remembered between batches, also of other sessions. Buckets follow ``lines``, the number expected in all; they are fixed once runs exist."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 2, state: dict | None = None, lines: int = 0):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or fresh_path(spark, "line-runs")
        state = state or {}
        self.buckets: int = state.get("buckets") or max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines // BUCKET)
        self.levels: list[list[str]] = [list(x) for x in state.get("levels", [])]
        self.ledger: list[str] = list(state.get("ledger", []))
        self.tables: dict[str, str] = {}

    @property
    def state(self) -> dict:
        return {"buckets": self.buckets, "levels": [list(x) for x in self.levels], "ledger": list(self.ledger)}

    def _table(self, path: str) -> str:
        """The session's name for the run in ``path``: only a bucketed table tells Spark how a run is dealt and sorted."""
        if path not in self.tables:
            name = self.tables[path] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.tables[path]

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.select("hash", "docs").write.insertInto(self._table(path))
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.table(self._table(path))

    @property
    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _merged(self, paths: list[str]) -> DataFrame:
        """Runs as one, by merge joins: as no two share a hash, each row has one side only."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.withColumnRenamed("docs", "more").hint("merge"), "hash", "full_outer").select("hash", F.coalesce("docs", "more").alias("docs"))

        return reduce(merge, map(self._read, paths))

    def totals(self, least: int = 1) -> DataFrame:
        """Every hash of ``least`` documents or more once, with their number."""
        if not self.levels:
            return self.spark.createDataFrame([], RUN)
        runs = map(self._read, self.paths)
        if self.ledger:
            more = written(self.spark.read.schema(RUN).parquet(*self.ledger).groupBy("hash").agg(F.sum("docs").alias("more")), "ledger")
            runs = [r.join(more.hint("merge"), "hash", "left").select("hash", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")) for r in runs]
        return reduce(DataFrame.unionByName, runs).where(F.col("docs") >= least)

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of ``hashes`` whose ``hash`` no run holds."""
        return reduce(lambda rows, p: rows.join(self._read(p).select("hash").hint("merge"), "hash", "left_anti"), self.paths, hashes)

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch, a row for each hash and document that has it; then compacts full levels."""
        path = self._write(hashes.groupBy("hash").agg(F.count("*").alias("docs")))
        if self.levels:
            batch, path = path, self._write(self.unseen(self._read(path)))
            self.ledger.append(f"{self.folder}/ledger-{uuid.uuid4().hex}")
            self._read(batch).join(self._read(path).select("hash").hint("merge"), "hash", "left_anti").write.parquet(self.ledger[-1])
            self._drop([batch])
        level = 0
        while True:
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < self.fanout:
                return
            path = self._write(self._merged(self.levels[level]))
            self._drop(self.levels[level])
            self.levels[level] = []
            level += 1

    def _drop(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(p, 'line_run_none')}")
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def forget(self) -> None:
        """Takes the runs' names out of the session; their folders stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def line_table(rows: DataFrame, least: int = 1) -> DataFrame:
    """(_row, pos, hash, first) for every line of ``rows`` (_row, _text) whose key has ``least`` code points or more; ``first`` marks a key's first line in its text."""
    keys = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    ordered = F.sort_array(F.filter(keys, lambda x: F.length(x["key"]) >= least))

    def marked(xs: Column) -> Column:
        return F.transform(xs, lambda x, i: F.struct(x["key"].alias("key"), x["pos"].alias("pos"), F.coalesce(F.get(xs, i - 1)["key"] != x["key"], F.lit(True)).alias("first")))

    return rows.select("_row", F.inline(let(ordered, marked))).select("_row", "pos", line_hash(F.col("key")).alias("hash"), "first")


def line_runs(lines: DataFrame, batches: int = 3, fanout: int = 2) -> LineRuns:
    """The runs of a table of lines (batch, hash, first), taken in ``batches``."""
    runs = LineRuns(lines.sparkSession, fanout=fanout, lines=lines.count())
    try:
        for b in range(batches):
            runs.add(lines.where((F.col("batch") == b) & F.col("first")).select("hash"))
    except Exception:
        runs.forget()
        raise
    return runs


def batches_of(docs: DataFrame, batch_docs: int = 20_000_000, most: int = 64) -> int:
    """How many batches to take ``docs`` in: of ``batch_docs`` rows, but three at least, so that runs are compacted, and ``most`` at most."""
    return min(most, max(3, docs.count() // batch_docs))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least: int = 1, carry: tuple[str, ...] = (), runs: LineRuns | None = None, batches: int | None = None) -> DataFrame:
    """Drops the lines whose key (of ``least`` code points or more) at least ``least_docs`` rows of ``docs`` hold, or of those that ``runs`` were made from.

    Per row its id, the ``carry`` columns, ``n_lines``, ``n_dropped`` and ``kept_text``.
    Null and empty texts are one empty line, which stays; a line that repeats within a
    text counts that text once; repeated rows count as documents of their own; an empty
    table gives no rows. Columns that are not named are ignored.
    """
    names = list(dict.fromkeys((id_col, *carry)))
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("_named"), F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    rows = rows.select("_named", "_text", row_key("_id", F.col("_text")).alias("_row"))
    batches = batches or batches_of(docs)
    # One reading of the texts serves the runs and, by its positions, the lines to drop.
    placed = line_table(rows, least).withColumn("batch", F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int"))
    path = fresh_path(docs.sparkSession, "lines")
    placed.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema("_row binary, pos int, hash binary, first boolean, batch int").parquet(path)
    own = runs or line_runs(lines, batches)
    # A table of its own, so that both sides of the join are plain exchanges and a very common line's rows can be split.
    try:
        common = written(own.totals(least_docs).select("hash"), "common-lines")
    finally:
        if runs is None:
            own.forget()
    hits = lines.select("_row", "pos", "hash").join(common, "hash", "left_semi")
    drop = hits.groupBy("_row").agg(F.collect_set("pos").alias("_drop"))

    def without(ls: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop"))
        return F.array_join(F.transform(stay, lambda p: F.get(ls, p)), "\n")

    split = F.split("_text", "\n", -1)
    out = rows.join(drop, "_row", "left")
    done = out.select(
        "_named",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(let(split, without)).alias("kept_text"),
    )
    return done.select(*[F.col("_named")[c].alias(c) for c in names], "n_lines", "n_dropped", "kept_text")
