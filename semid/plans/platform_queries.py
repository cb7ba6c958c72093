"""Relational and streaming coverage beyond the operators: joins, groupings, ranking, sets, event-time windows, streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from semid.functions.formulas import by_key, formula
from semid.operators import settings
from semid.plans.common import r6, table
from semid.session import scratch
from semid.streaming import streams


def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


def regional_revenue(spark, sf_dir):
    """Five tables; the two smallest (25 and 5 rows) are broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def grouping_cube(spark, sf_dir):
    x = table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("g"))
    return x.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "g")


def rank_in_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("intersect", c.intersect(s)), ("except", c.exceptAll(s).distinct()), ("union", c.union(s).distinct())]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("op"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def event_windows(spark, sf_dir):
    x = streams.windowed_counts(table(spark, sf_dir, "events"), "1 day")
    return x.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "6 hours")


def _drained(stream, spark):
    """All rows that a stream appends, by way of a table in the shared folder."""
    path = scratch(spark, "stream")
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _streamed(spark, sf_dir, name):
    """A table as a stream. As a pattern, the path may be one file or a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _event_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, "events")


def stream_event_windows(spark, sf_dir):
    """The daily windows by a stream run to its end, in complete mode; the result, a row a window and type, is kept in memory."""
    x = _event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    name = f"s_{uuid.uuid4().hex}"
    q = x.select(F.col("window.start").alias("start"), "event_type", "n").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream_wealth_deltas(spark, sf_dir):
    """A stateful stream: each user's change of value against the event before."""
    x = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("wealth"))
    return _drained(streams.wealth_deltas(x), spark).select("episode_id", "step", r6("delta").alias("delta"))


def stream_idle_deltas(spark, sf_dir):
    """A stateful stream with timers: each user's change of value against the event before, from 0 again after ten idle hours."""
    streams.stateful(spark)
    x = streams.idle_deltas(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", "value", idle_ms=10 * 3_600_000, late="1 day")
    return _drained(x, spark).select("user_id", "event_id", r6("delta").alias("delta"))


def stream_codebook(spark, sf_dir):
    """Mini-batch centroids that a stream over the vectors leaves in its folder."""
    path = scratch(spark, "codebook")
    it = table(spark, sf_dir, "embeddings")
    start = [list(r["v"]) for r in it.where("vec_id < 8").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("vec_id").collect()]  # 8 rows
    learner = streams.CodebookLearner(spark, start, f"{path}/book")
    source = _streamed(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    source.writeStream.foreachBatch(learner.update).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(learner.ROW).parquet(f"{path}/book/epoch={learner.epochs()[-1]}")
    return last.where("n > 0").select("code", F.col("n").cast("bigint").alias("n"), r6(F.get("vec", F.lit(0))).alias("v0"), r6(F.get("vec", F.lit(63))).alias("v63"))


def props_deep_merge(spark, sf_dir):
    """Two versions of each event's properties, nested and merged, then changed at a path."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    first = F.struct(F.struct(F.col("k").alias("value"), F.lit("first").alias("from")).alias("k"), F.struct(F.col("event_type").alias("type"), F.struct(F.col("event_id").alias("id")).alias("ref")).alias("meta"), F.lit(1).alias("version"))
    nested = F.struct(F.struct((F.col("k") * 2).alias("value")).alias("k"), F.struct(F.struct(F.lit("x").alias("tag")).alias("ref")).alias("meta"), F.lit(2).alias("version"))
    flat = F.struct(F.lit("gone").alias("k"), F.struct(F.lit("none").alias("ref")).alias("meta"))
    second = F.when(F.col("event_id") % 3 == 0, F.to_json(nested)).when(F.col("event_id") % 3 == 1, F.to_json(flat)).otherwise("{}")
    docs = e.select("event_id", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.to_json(first).alias("j")), F.struct(F.lit(1).alias("level"), second.alias("j")))).alias("v"))
    changes = e.where("event_id % 10 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("meta.note.k="), F.col("k").cast("string")).alias("override"), F.lit(0).alias("n"))
    out = settings.deep_merge(docs.select("event_id", "v.level", F.parse_json("v.j").alias("doc")), "event_id", "doc", "level", changes)
    read = lambda p, kind="string": settings.read(F.col("doc"), p, kind)
    return out.select(F.col("id").alias("event_id"), read("k.value", "bigint").alias("k_value"), read("k.from").alias("k_from"), read("k").alias("k"), read("meta.type").alias("type"), read("meta.ref.id", "bigint").alias("ref_id"), read("meta.ref.tag").alias("ref_tag"), read("meta.ref").alias("ref"), read("version", "bigint").alias("version"), read("meta.note.k", "bigint").alias("note"))


def formulas(spark, sf_dir):
    """Arithmetic texts over line items: precedence, signs, exclusive or, powers."""
    texts = {"a": "1 + 2*3**2 / (5 + -6) + l_linenumber", "b": "l_orderkey ^ l_partkey + 1", "c": "-l_quantity * (l_extendedprice - 2) ** 2 / 1027", "d": "2**-1 * l_linenumber - -3"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(formula(t).cast("double"), 4).alias(n) for n, t in texts.items()])


def items_by_key(spark, sf_dir):
    """Each order's prices by part; of lines of one part the last counts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("n")))).alias("x"))
    return lines.select("l_orderkey", F.explode(by_key(F.col("x"), "part", "n")).alias("part", "n"))


NAMES = "formulas items_by_key stream_idle_deltas stream_codebook props_deep_merge pricing_summary regional_revenue grouping_cube rank_in_group set_operations customers_without_orders event_windows event_sessions stream_event_windows stream_wealth_deltas".split()
QUERIES = {n: globals()[n] for n in NAMES}
DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n{0} FROM events GROUP BY ALL"
ORACLES = {
    "formulas": "SELECT l_orderkey, l_linenumber, round(CAST(1 + 2 * 9 / (5 + -6) + l_linenumber AS DOUBLE), 4) AS a, round(CAST(xor(l_orderkey, l_partkey + 1) AS DOUBLE), 4) AS b, round(-l_quantity * pow(l_extendedprice - 2, 2) / 1027, 4) AS c, round(CAST(0.5 * l_linenumber + 3 AS DOUBLE), 4) AS d FROM lineitem",
    "items_by_key": "SELECT l_orderkey, l_partkey AS part, l_quantity AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM lineitem WHERE l_discount > 0.01) WHERE r = 1",
    "stream_idle_deltas": "SELECT user_id, event_id, round(CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 HOUR THEN value - lag(value) OVER w ELSE 0 END, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "props_deep_merge": """WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
        m AS (SELECT event_id, k, json_merge_patch(json_object('k', json_object('value', k, 'from', 'first'), 'meta', json_object('type', event_type, 'ref', json_object('id', event_id)), 'version', 1),
          CASE event_id % 3 WHEN 0 THEN json_object('k', json_object('value', k * 2), 'meta', json_object('ref', json_object('tag', 'x')), 'version', 2) WHEN 1 THEN json_object('k', 'gone', 'meta', json_object('ref', 'none')) ELSE '{}' END) AS d FROM e)
        SELECT event_id, CAST(d->>'$.k.value' AS BIGINT) AS k_value, d->>'$.k.from' AS k_from, CASE WHEN json_type(d, '$.k') = 'VARCHAR' THEN d->>'$.k' END AS k, d->>'$.meta.type' AS type, CAST(d->>'$.meta.ref.id' AS BIGINT) AS ref_id, d->>'$.meta.ref.tag' AS ref_tag,
          CASE WHEN json_type(d, '$.meta.ref') = 'VARCHAR' THEN d->>'$.meta.ref' END AS ref, CAST(d->>'$.version' AS BIGINT) AS version, CASE WHEN event_id % 10 = 0 THEN k END AS note FROM m""",
    "stream_codebook": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id AS code, v AS c FROM v WHERE vec_id < 8),
        d AS (SELECT vec_id, v, code, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS dist FROM v, c), n AS (SELECT vec_id, any_value(v) AS v, arg_min(code, dist) AS code FROM d GROUP BY vec_id)
        SELECT CAST(code AS INTEGER) AS code, count(*) AS n, round(avg(v[1]), 6) AS v0, round(avg(v[64]), 6) AS v63 FROM n GROUP BY code""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "regional_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "grouping_cube": "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(grouping_id(lang, source) AS BIGINT) AS g FROM documents GROUP BY CUBE (lang, source)",
    "rank_in_group": "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "set_operations": "WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier) SELECT 'intersect' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT DISTINCT k FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)) UNION ALL SELECT 'union', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT k FROM c UNION SELECT k FROM s)",
    "customers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "event_windows": DAYS.format(", round(sum(value), 4) AS total"),
    "event_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM y GROUP BY user_id, g",
    "stream_event_windows": DAYS.format(""),
    "stream_wealth_deltas": "SELECT CAST(user_id AS VARCHAR) AS episode_id, CAST(event_id AS INTEGER) AS step, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 6) AS delta FROM events",
}
