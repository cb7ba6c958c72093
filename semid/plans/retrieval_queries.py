"""Queries of rankings and constrained generation. Search queries are the vectors whose id 50 divides, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from semid.operators import retrieval as R
from semid.operators.quantize import kmeans_plus_plus
from semid.plans.common import ITEMS_SQL, dot_sql, items, joined, r6
from semid.plans.quantize_queries import assigned, residual_sql


def _search(spark, sf_dir):
    it = items(spark, sf_dir)
    return it.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), it.select(F.col("id").alias("key_id"), "vec")


def _relevant(spark, sf_dir):
    """The ten best others of each query: it is among its own eleven best, or the eleventh is one too many."""
    labels = items(spark, sf_dir).select("id", "label")
    others = R.top_k_by_dot(*_search(spark, sf_dir), 11).where("query_id <> key_id").drop("rank")
    top = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id"))).where("rank <= 10")
    top = top.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("q")), "query_id").join(labels.select(F.col("id").alias("key_id"), F.col("label").alias("k")), "key_id")
    return top.select("query_id", "rank", (F.col("q") == F.col("k")).cast("int").alias("relevant"))


def topk_dot_full_vocab(spark, sf_dir):
    return R.top_k_by_dot(*_search(spark, sf_dir), 10).select("query_id", "key_id", "rank", r6("score").alias("score"))


def _pruned(spark, sf_dir):
    cells = kmeans_plus_plus(items(spark, sf_dir), 16)
    return R.top_k_pruned(*_search(spark, sf_dir), 10, cells)


def topk_pruned(spark, sf_dir):
    return _pruned(spark, sf_dir).top.select("query_id", "key_id", "rank", r6("score").alias("score"))


def topk_pruned_blocks(spark, sf_dir):
    return _pruned(spark, sf_dir).blocks


def recall_at_k(spark, sf_dir):
    return R.ranking_metrics(_relevant(spark, sf_dir), [5, 10]).select("query_id", "k", r6("recall").alias("recall"))


def ndcg_at_k(spark, sf_dir):
    return R.ranking_metrics(_relevant(spark, sf_dir), [5, 10]).select("query_id", "k", r6("ndcg").alias("ndcg"))


def mean_ranking_metrics(spark, sf_dir):
    return R.mean_metrics(R.ranking_metrics(_relevant(spark, sf_dir), [5, 10])).select("name", r6("value").alias("value"))


def _users(spark, sf_dir):
    return items(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("user_id"))


def _beams(spark, sf_dir):
    sids = assigned(spark, sf_dir)
    return R.beam_search(_users(spark, sf_dir), R.transition_table(sids, 2), 2, 5, valid=sids)


def beam_search_constrained(spark, sf_dir):
    return _beams(spark, sf_dir).select("user_id", joined("codes").alias("codes"), "rank", r6("prob").alias("prob"))


def sid_match_eval(spark, sf_dir):
    wanted = assigned(spark, sf_dir).groupBy("label").agg(F.min(F.struct("id", "codes")).alias("m")).select(F.col("label").alias("user_id"), F.col("m.codes").alias("codes"))
    hits = R.ranked_hits(_beams(spark, sf_dir), wanted)
    return hits.select("user_id", "rank", joined("codes").alias("codes"), "relevant")


def prefix_semi_join(spark, sf_dir):
    every = spark.range(64).select(F.array((F.col("id") / 8).cast("int"), (F.col("id") % 8).cast("int")).alias("prefix"))
    return R.valid_prefixes(every, assigned(spark, sf_dir), 2).select(joined("prefix").alias("prefix"))


def sampled_negatives_eval(spark, sf_dir):
    queries = items(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("positive"))
    last = items(spark, sf_dir).agg(F.max("id")).first()[0]  # one row
    return R.sampled_negatives(queries, 20, (last or 0) + 1, 1, 42)


NAMES = "topk_dot_full_vocab topk_pruned topk_pruned_blocks recall_at_k ndcg_at_k mean_ranking_metrics beam_search_constrained sid_match_eval prefix_semi_join sampled_negatives_eval".split()
QUERIES = {n: globals()[n] for n in NAMES}

def _top_sql(where: str) -> str:
    return f"""{ITEMS_SQL},
s AS (SELECT q.id AS query_id, k.id AS key_id, q.label AS ql, k.label AS kl, {dot_sql("q.vec", "k.vec")} AS score FROM it q, it k WHERE q.id % 50 = 0{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM s),
t AS (SELECT query_id, key_id, rank, score, CASE WHEN ql = kl THEN 1 ELSE 0 END AS relevant FROM r WHERE rank <= 10),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, rank) AS ideal FROM t),
m AS (SELECT query_id, CAST(k AS INTEGER) AS k,
  sum(CASE WHEN rank <= k THEN relevant ELSE 0 END) / greatest(1, least(sum(relevant), k)) AS recall,
  sum(CASE WHEN rank <= k THEN relevant / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= k THEN relevant / log2(ideal + 1.0) ELSE 0 END) AS idcg
  FROM i, (VALUES (5), (10)) v(k) GROUP BY query_id, k),
n AS (SELECT query_id, k, recall, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM m)"""


ALL, TOP = _top_sql(""), _top_sql(" AND q.id <> k.id")
BEAM = f"""{residual_sql()},
w AS (SELECT c1, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY c1),
x AS (SELECT c1, p, row_number() OVER (ORDER BY p DESC, c1) AS r1 FROM w),
y AS (SELECT c1, c2, count(*) / (SELECT count(*) FROM a b WHERE b.c1 = a.c1) AS p2 FROM a GROUP BY c1, c2),
z AS (SELECT x.c1, y.c2, p * p2 AS prob, row_number() OVER (ORDER BY p * p2 DESC, r1, c2) AS rank FROM x JOIN y ON x.c1 = y.c1 WHERE r1 <= 5),
u AS (SELECT DISTINCT label AS user_id FROM embeddings),
b AS (SELECT user_id, c1, c2, prob, CAST(rank AS INTEGER) AS rank FROM u, z WHERE rank <= 5)"""
ORACLES = {
    "topk_dot_full_vocab": f"WITH {ALL} SELECT query_id, key_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM t",
    "topk_pruned": f"WITH {ALL} SELECT query_id, key_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM t",
    "recall_at_k": f"WITH {TOP} SELECT query_id, k, round(recall, 6) AS recall FROM n",
    "ndcg_at_k": f"WITH {TOP} SELECT query_id, k, round(ndcg, 6) AS ndcg FROM n",
    "mean_ranking_metrics": f"WITH {TOP} SELECT 'recall@' || k AS name, round(avg(recall), 6) AS value FROM n GROUP BY k UNION ALL SELECT 'ndcg@' || k, round(avg(ndcg), 6) FROM n GROUP BY k",
    "beam_search_constrained": f"WITH {BEAM} SELECT user_id, c1 || ',' || c2 AS codes, rank, round(prob, 6) AS prob FROM b",
    "sid_match_eval": f"WITH {BEAM}, g AS (SELECT label AS user_id, arg_min(c1, id) AS g1, arg_min(c2, id) AS g2 FROM a GROUP BY label) SELECT user_id, rank, c1 || ',' || c2 AS codes, CASE WHEN c1 = g1 AND c2 = g2 THEN 1 ELSE 0 END AS relevant FROM b JOIN g USING (user_id)",
    "prefix_semi_join": f"WITH {residual_sql()} SELECT DISTINCT c1 || ',' || c2 AS prefix FROM a",
    "sampled_negatives_eval": "SELECT vec_id AS query_id, CAST(j.range AS INTEGER) AS j, CASE WHEN j.range = 0 THEN vec_id ELSE 1 + CAST('0x' || substr(md5(vec_id || '|' || j.range || '|42'), 1, 12) AS BIGINT) % (SELECT max(vec_id) FROM embeddings) END AS key_id FROM embeddings, range(21) j WHERE vec_id % 50 = 0",
}
