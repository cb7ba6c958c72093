"""Queries of codes from vectors. The codebook of the queries is stated: vectors 0 to 7, and half the unit vectors 8 to 15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semid.functions import vectors as V
from semid.operators import quantize as Q
from semid.plans.common import ITEMS_SQL, items, joined, r6, sq, sub_sql, unit_sql


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    first = it.where("id < 8").select(F.lit(0).alias("level"), F.col("id").cast("int").alias("code"), "vec")
    second = it.where("id >= 8 and id < 16").select(F.lit(1).alias("level"), (F.col("id") - 8).cast("int").alias("code"), V.scale(V.unit(F.col("vec")), F.lit(0.5)).alias("vec"))
    return first.unionByName(second)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.assign(items(spark, sf_dir), codebook(spark, sf_dir))


def sid_assign_residual(spark, sf_dir):
    out = Q.collision_digit(assigned(spark, sf_dir))
    return out.select(F.col("id").alias("vec_id"), F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"), F.col("digit").alias("collision"))


def nearest_centroid(spark, sf_dir):
    first = Q.codebook_rows(codebook(spark, sf_dir))[0]
    best = Q.nearest(F.col("vec"), Q.centroids_column(first))
    return items(spark, sf_dir).select(F.col("id").alias("vec_id"), best.alias("b")).select("vec_id", F.col("b.code").alias("code"), r6("b.dist").alias("dist"))


def sid_collision_digit(spark, sf_dir):
    out = Q.collision_digit(assigned(spark, sf_dir))
    return out.groupBy(F.col("digit").alias("collision")).agg(F.count("*").alias("n"))


def sid_level_coverage_entropy(spark, sf_dir):
    return Q.coverage_entropy(assigned(spark, sf_dir), 8).select("level", "used", r6("coverage").alias("coverage"), r6("entropy").alias("entropy"))


def sid_unique_fraction(spark, sf_dir):
    return Q.unique_fraction(assigned(spark, sf_dir)).select("tuples", "items", r6("fraction").alias("fraction"))


def residual_norm_ratio(spark, sf_dir):
    return Q.norm_ratio(assigned(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("residual_ratio", "quantized_ratio", "mse")])


def _flat(spark, centroids):
    rows = [(i, j, float(x)) for i, c in enumerate(centroids) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "code int, dim int, x double").select("code", "dim", r6("x").alias("x"))


def kmeans_minibatch_step(spark, sf_dir):
    first = Q.codebook_rows(codebook(spark, sf_dir))[0]
    return _flat(spark, Q.minibatch_step(items(spark, sf_dir), first, [10.0] * 8)[0])


def ema_codebook_step(spark, sf_dir):
    first = Q.codebook_rows(codebook(spark, sf_dir))[0]
    return _flat(spark, Q.ema_step(items(spark, sf_dir), first, [1.0] * 8, first)[0])


def codebook_usage(spark, sf_dir):
    return Q.codebook_usage(Q.code_counts(assigned(spark, sf_dir)), 8).select("level", r6("usage").alias("usage"))


def dead_codes(spark, sf_dir):
    return Q.dead_codes(Q.assign(items(spark, sf_dir), codebook(spark, sf_dir), normalize=False), spark, 2, 16)


def sid_dense_matrix(spark, sf_dir):
    """One row for each id up to the last item's, and at least 2000 rows, so that small tables show the fill."""
    rows = assigned(spark, sf_dir).select("id", joined("codes").alias("codes"))
    last = items(spark, sf_dir).agg(F.max("id")).first()[0]  # one row
    return Q.dense_matrix(rows.withColumn("at", F.col("id")), max(2000, (last or 0) + 1), "id", "codes", "at", "0,0")


def sid_transpose_pivot(spark, sf_dir):
    """A row for each level and 100 items: their codes in the order of their ids."""
    return Q.transpose(assigned(spark, sf_dir), block=100).select("level", "block", "first", joined("codes").alias("codes"))


def kmeans_learned_codes(spark, sf_dir):
    """A learned two-level codebook's codes: in range, and as many rows as items."""
    it = items(spark, sf_dir)
    book = Q.learn_codebook(it, 2, 8, steps=3, seed=7)
    return Q.assign(it, book, engine="arrow").select(F.col("id").alias("vec_id"), F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"))


def soft_assignment(spark, sf_dir):
    first = Q.centroids_column(Q.codebook_rows(codebook(spark, sf_dir))[0])
    logits = F.transform(first, lambda c: -V.sqdist(F.col("vec"), c))
    soft = V.softmax(logits)
    return items(spark, sf_dir).select(F.col("id").alias("vec_id"), r6(F.array_max(soft)).alias("top"), r6(V.cross_entropy(logits, F.lit(0))).alias("ce0"))


CB = f"""{ITEMS_SQL},
cb0 AS (SELECT CAST(id AS INTEGER) AS code, vec AS c FROM it WHERE id < 8),
cb1 AS (SELECT CAST(id - 8 AS INTEGER) AS code, list_transform({unit_sql("vec")}, lambda x: x * 0.5) AS c FROM it WHERE id >= 8 AND id < 16)"""


def _level(source: str, name: str, cb: str, vec: str, unit: bool) -> str:
    v = unit_sql(vec) if unit else vec
    return f"""u{name} AS (SELECT * EXCLUDE ({vec}), {v} AS v FROM {source}),
d{name} AS (SELECT u.*, cb.code, cb.c, {sq("u.v", "cb.c")} AS dist FROM u{name} u CROSS JOIN {cb} cb),
b{name} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, code) AS rn FROM d{name})"""


def residual_sql(unit: bool = True) -> str:
    return f"""{CB},
s0 AS (SELECT id, label, vec AS orig, vec FROM it),
{_level("s0", "0", "cb0", "vec", unit)},
s1 AS (SELECT id, label, orig, code AS c1, c AS q0, {sub_sql("v", "c")} AS vec FROM b0 WHERE rn = 1),
{_level("s1", "1", "cb1", "vec", unit)},
a AS (SELECT id, label, orig, c1, code AS c2, {sub_sql("v", "c")} AS residual, list_transform(range(1, len(c) + 1), lambda i: q0[i] + c[i]) AS quantized FROM b1 WHERE rn = 1)"""


COLL = "CASE WHEN count(*) OVER (PARTITION BY c1, c2) > 1 THEN row_number() OVER (PARTITION BY c1, c2 ORDER BY id) ELSE 0 END"
LONG = "l AS (SELECT 1 AS level, c1 AS code FROM a UNION ALL SELECT 2, c2 FROM a)"
BEST0 = f"{CB}, s0 AS (SELECT id, vec FROM it), {_level('s0', '0', 'cb0', 'vec', False)}"
SUMS = f"""{BEST0},
e AS (SELECT code, unnest(v) AS x, unnest(range(len(v))) AS dim FROM b0 WHERE rn = 1),
g AS (SELECT code, dim, sum(x) AS s FROM e GROUP BY code, dim),
n AS (SELECT code, count(*) AS n FROM b0 WHERE rn = 1 GROUP BY code),
o AS (SELECT code, unnest(c) AS c, unnest(range(len(c))) AS dim FROM cb0),
z AS (SELECT o.code, o.dim, o.c, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s FROM o LEFT JOIN n ON o.code = n.code LEFT JOIN g ON g.code = o.code AND g.dim = o.dim)"""
SQ0 = "list_sum(list_transform({0}, lambda x: x * x))"

QUERIES = {f.__name__: f for f in (sid_assign_residual, nearest_centroid, sid_collision_digit, sid_level_coverage_entropy, sid_unique_fraction, residual_norm_ratio, kmeans_minibatch_step, ema_codebook_step, codebook_usage, dead_codes, sid_dense_matrix, sid_transpose_pivot, kmeans_learned_codes, soft_assignment)}
ORACLES = {
    "sid_assign_residual": f"WITH {residual_sql()} SELECT id AS vec_id, c1, c2, CAST({COLL} AS INTEGER) AS collision FROM a",
    "nearest_centroid": f"WITH {BEST0} SELECT id AS vec_id, code, round(dist, 6) AS dist FROM b0 WHERE rn = 1",
    "sid_collision_digit": f"WITH {residual_sql()}, x AS (SELECT CAST({COLL} AS INTEGER) AS collision FROM a) SELECT collision, count(*) AS n FROM x GROUP BY collision",
    "sid_level_coverage_entropy": f"WITH {residual_sql()}, {LONG}, f AS (SELECT level, code, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT level, n / sum(n) OVER (PARTITION BY level) AS p FROM f) SELECT level, count(*) AS used, round(count(*) / 8.0, 6) AS coverage, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY level",
    "sid_unique_fraction": f"WITH {residual_sql()}, t AS (SELECT c1, c2, count(*) AS n FROM a GROUP BY ALL) SELECT count(*) AS tuples, CAST(sum(n) AS BIGINT) AS items, round(count(*) / sum(n), 6) AS fraction FROM t",
    "residual_norm_ratio": f"WITH {residual_sql()} SELECT round(sqrt(sum({SQ0.format('residual')}) / sum({SQ0.format('orig')})), 6) AS residual_ratio, round(sqrt(sum({SQ0.format('quantized')}) / sum({SQ0.format('orig')})), 6) AS quantized_ratio, round(avg({sq('orig', 'quantized')} / len(orig)), 6) AS mse FROM a",
    "kmeans_minibatch_step": f"WITH {SUMS} SELECT code, CAST(dim AS INTEGER) AS dim, round(CASE WHEN n = 0 THEN c ELSE c + (s / n - c) * n / (10.0 + n) END, 6) AS x FROM z",
    "ema_codebook_step": f"WITH {SUMS}, y AS (SELECT code, dim, 0.99 * 1.0 + (1 - 0.99) * n AS size, 0.99 * c + (1 - 0.99) * s AS total FROM z), t AS (SELECT sum(size) AS n FROM y WHERE dim = 0) SELECT code, CAST(dim AS INTEGER) AS dim, round(total / greatest((size + 1e-5) / (n + 8 * 1e-5) * n, 1e-5), 6) AS x FROM y, t",
    "codebook_usage": f"WITH {residual_sql()}, {LONG} SELECT level, round(count(DISTINCT code) / 8.0, 6) AS usage FROM l GROUP BY level",
    "dead_codes": f"WITH {residual_sql(False)}, {LONG}, e AS (SELECT CAST(l.range AS INTEGER) AS level, CAST(k.range AS INTEGER) AS code FROM range(1, 3) l, range(16) k) SELECT level, code FROM e WHERE (level, code) NOT IN (SELECT level, code FROM l)",
    "sid_dense_matrix": f"WITH {residual_sql()} SELECT r.id, coalesce(c1 || ',' || c2, '0,0') AS codes FROM (SELECT unnest(range(greatest(2000, max(vec_id) + 1))) AS id FROM embeddings) r LEFT JOIN a ON a.id = r.id",
    "sid_transpose_pivot": f"WITH {residual_sql()}, o AS (SELECT id, c1, c2, (row_number() OVER (ORDER BY id) - 1) // 100 AS block FROM a), l AS (SELECT id, block, 1 AS level, c1 AS code FROM o UNION ALL SELECT id, block, 2, c2 FROM o) SELECT level, block, min(id) AS first, string_agg(code, ',' ORDER BY id) AS codes FROM l GROUP BY level, block",
    "soft_assignment": f"WITH {BEST0}, g AS (SELECT id, list(-dist ORDER BY code) AS z FROM d0 GROUP BY id), e AS (SELECT id, z, list_max(z) AS m, list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS s FROM g) SELECT id AS vec_id, round(1 / s, 6) AS top, round(ln(s) + m - z[1], 6) AS ce0 FROM e",
}
