"""Queries of completion scores, dense evaluation, encoding, and of small operators that have no group of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.functions import text as T
from semid.functions import vectors as V
from semid.operators import encoding, episodes, evaluation, graphs, retrieval, sampling, sequences
from semid.plans.common import ITEMS_SQL, dot_sql, items, joined, r6, sq, table, unit_sql
from semid.plans.sampling_queries import number
from semid.plans.sequence_queries import H, histories
from semid.plans.text_queries import IDENT
from semid.session import scratch
from semid.sources import files, sinks


def _completions(spark, sf_dir):
    """Each turn as the prediction of the turn before it: the prompt is its role, the language alternates."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    x = turns.join(before, ["conv_id", "turn"])
    return x.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat("role", F.lit(" = ")).alias("prompt"), F.col("text").alias("predicted"), "reference", F.when(F.col("turn") % 2 == 0, "python").otherwise("go").alias("language"))


def exact_match_edit_ratio(spark, sf_dir):
    scores = evaluation.completion_scores(_completions(spark, sf_dir))
    return scores.select("id", *[r6(s).alias(s) for s in evaluation.SCORES])


def completion_means(spark, sf_dir):
    return evaluation.completion_means(evaluation.completion_scores(_completions(spark, sf_dir)))


def dense_eval_negatives(spark, sf_dir):
    """Queries 0, 50, 100 ...; the positive is the next vector, the negatives 20 draws from all ids."""
    it = items(spark, sf_dir)
    last = it.agg(F.max("id")).first()[0] or 0  # one row
    asked = it.where("id % 50 = 0").select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("positive"), "vec")
    drawn = retrieval.sampled_negatives(asked, 20, last + 1, 1, 42)
    ranked = evaluation.dense_evaluation(drawn, it.select(F.col("id").alias("key_id"), "vec"), asked)
    return retrieval.ranking_metrics(ranked, [1, 5, 10]).select("query_id", "k", r6("recall").alias("recall"), r6("ndcg").alias("ndcg"))


def text_to_ids(spark, sf_dir):
    import public_tokenizers

    out = encoding.text_to_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"), 128)
    return out.select("doc_id", F.md5(joined("text_ids")).alias("ids"), F.aggregate("text_mask", F.lit(0), lambda a, x: a + x).alias("n"), F.size("text_mask").alias("length"))


def weighted_views(spark, sf_dir):
    it = items(spark, sf_dir)
    views = {"signature": F.col("vec"), "docstring": F.reverse("vec"), "body": F.transform("vec", lambda x: x * x), "path": F.col("vec")}
    out = graphs.weighted_views(views, {"signature": 0.4, "docstring": 0.2, "body": 0.3, "path": 0.0})
    return it.select(F.col("id").alias("vec_id"), out.alias("v")).select("vec_id", r6(F.get("v", F.lit(0))).alias("v0"), r6(F.get("v", F.lit(63))).alias("v63"))


def sibling_sids(spark, sf_dir):
    """Parts of one brand, type and size as the members of a class."""
    code = F.array(F.pmod("p_partkey", F.lit(64)).cast("int"), F.pmod(F.floor(F.col("p_partkey") / 64), F.lit(64)).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", T.sid_sequence(code, 2, False).alias("sid"))
    return graphs.siblings(parts, ["p_brand", "p_type", "p_size"], "sid").select("p_partkey", "sid", joined("siblings").alias("siblings"))


def sampled_subsequences(spark, sf_dir):
    parts = sampling.sampled_subsequences(F.col("seq"), F.col("user_id"), 5)
    return histories(spark, sf_dir).select("user_id", F.posexplode(parts).alias("pos", "part")).select("user_id", "pos", joined("part").alias("part"))


def probe_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("text").alias("answer"), F.concat(F.lit(" "), F.upper("lang")).alias("expected"))
    return evaluation.probe_answers(rows).groupBy("source").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"), r6(F.avg("correct")).alias("accuracy"))


def group_means(spark, sf_dir):
    return graphs.group_means(items(spark, sf_dir), "label", "vec", 64).select("label", r6(F.get("vec", F.lit(0))).alias("v0"), r6(F.get("vec", F.lit(63))).alias("v63"))


def gather_places(spark, sf_dir):
    h = histories(spark, sf_dir)
    places = h.select("user_id", F.explode(F.sequence(F.lit(0), F.size("seq") - 1, F.lit(3))).alias("col"))
    return sequences.gather(h, places, "user_id", "seq")


def text_helpers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(T.remove_chars(F.col("html"), "<>/")).alias("removed"), F.md5(T.between_tags(F.col("html"), "<title>", "</title>")).alias("title"), T.has_no_extension(F.col("url")).alias("bare"), T.after_segment(F.col("url"), "://", "x").alias("cut"))


def warmup_cosine(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(V.warmup_cosine(F.pmod("event_id", F.lit(400)).cast("double"), 40, 300, 0.1)).alias("factor"))


def rotation_trick(spark, sf_dir):
    """The value is the second vector; here the vector in reverse."""
    it = items(spark, sf_dir)
    return it.select(F.col("id").alias("vec_id"), V.rotation_trick(F.col("vec"), F.reverse("vec")).alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 4).alias("v0"), F.round(F.get("v", F.lit(63)), 4).alias("v63"))


def parquet_round_trip(spark, sf_dir):
    """Rows written in files of at most 1,000, and read back by a projected scan of all files listed."""
    path = scratch(spark, "rows")
    sinks.write_rows(table(spark, sf_dir, "events"), path, flush=1000, post=(lambda df: df.withColumn("double", F.col("value") * 2),))
    return files.read_table(spark, path, ["event_id", "double"])


def json_splits_round_trip(spark, sf_dir):
    path = scratch(spark, "splits")
    split = sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)
    sinks.write_splits(split, path)
    return files.read_table(spark, path, ["doc_id", "source", "split"], "doc_id bigint, source string, split string", "json")


def prediction_rows(spark, sf_dir):
    x = histories(spark, sf_dir).select(F.transform("seq", lambda s, i: F.col("user_id") * 1000 + i).alias("keys"), "seq")
    return sinks.prediction_rows(x, "keys", "seq")


def full_batch_loss(spark, sf_dir):
    """Queries 0, 50, 100 ... against all vectors; the label is the next one."""
    it = items(spark, sf_dir)
    asked = it.where("id % 50 = 0").select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("label"), "vec")
    return retrieval.full_cross_entropy(asked, it.select(F.col("id").alias("key_id"), "vec")).select("query_id", r6("loss").alias("loss"))


def quantization_losses(spark, sf_dir):
    x, q = F.col("vec"), F.reverse("vec")
    losses = {"weighted": F.sum(V.weighted_squared_error(x, q, 1 + F.col("id") % 3)), "quantization": F.sum(V.quantization_loss(x, q)), "mse": F.avg(V.sqdist(x, q) / F.size(x))}
    return items(spark, sf_dir).groupBy("label").agg(*[F.round(c, 4).alias(n) for n, c in losses.items()])


def squeezed_vectors(spark, sf_dir):
    it = items(spark, sf_dir).select("id", F.transform("vec", lambda x: F.array(x)).alias("column"), F.array("vec").alias("row"))
    column, row = V.squeeze(F.col("column")), V.squeeze(F.col("row"))
    return it.select(F.col("id").alias("vec_id"), F.size(column).alias("n"), r6(F.get(column, F.lit(0))).alias("v0"), r6(F.get(row, F.lit(63))).alias("v63"))


def feed_forward_scores(spark, sf_dir):
    """64 to 4 to 2, with weights by a rule."""
    weights = lambda m, n: ([[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(n)] for i in range(m)], [j / 10 for j in range(n)])
    out = encoding.feed_forward(items(spark, sf_dir).select("id", "vec"), "vec", [weights(64, 4), weights(4, 2)])
    return out.select(F.col("id").alias("vec_id"), r6(F.get("scores", F.lit(0))).alias("s0"), r6(F.get("scores", F.lit(1))).alias("s1"))


def random_policy(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", joined(episodes.random_actions(F.col("event_id"))).alias("actions"))


def candidates_reranked(spark, sf_dir):
    """Identifiers of even length have a tenth of it as their signal."""
    found = T.mine_identifiers(table(spark, sf_dir, "documents").select("text"))
    signals = found.where(F.length("token") % 2 == 0).select("token", (F.length("token") / 10).alias("signal"))
    return T.reranked(found, signals).select("token", "frequency", r6("signal").alias("signal"), r6("score").alias("score"), "strategy")


def registered_metrics(spark, sf_dir):
    """All metrics of the registry over the 20 nearest of each asked vector; those of its own label are relevant."""
    it = items(spark, sf_dir)
    asked = it.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"), "vec")
    near = retrieval.top_k_by_dot(asked, it.select(F.col("id").alias("key_id"), "vec"), 20)
    ranked = near.join(asked.select("query_id", "wanted"), "query_id").join(it.select(F.col("id").alias("key_id"), "label"), "key_id")
    names = tuple(retrieval.METRICS)
    per_query = retrieval.ranking_metrics(ranked.select("query_id", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("relevant")), [1, 5, 20], metrics=names)
    return retrieval.mean_metrics(per_query, names).select("name", r6("value").alias("value"))


NAMES = "exact_match_edit_ratio completion_means dense_eval_negatives text_to_ids weighted_views sibling_sids sampled_subsequences probe_accuracy group_means gather_places text_helpers warmup_cosine rotation_trick parquet_round_trip json_splits_round_trip prediction_rows full_batch_loss quantization_losses squeezed_vectors feed_forward_scores random_policy candidates_reranked registered_metrics".split()
QUERIES = {n: globals()[n] for n in NAMES}

VIEW = "0.4 / 0.9 * vec[{i}] + 0.2 / 0.9 * vec[65 - {i}] + 0.3 / 0.9 * vec[{i}] * vec[{i}]"
PART_SID = "'<SID_L1_' || lpad(CAST(p_partkey % 64 AS VARCHAR), 2, '0') || '><SID_L2_' || lpad(CAST(p_partkey // 64 % 64 AS VARCHAR), 2, '0') || '>'"
KEY = number("query_id || '|' || j || '|42'")
POLICY = [a[0] for a in episodes.ACTIONS if a[0] not in ("select_at", "drag_select")]
LAYER = "list_transform(range({n}), lambda j: list_sum(list_transform(range({m}), lambda i: {v}[i + 1] * ((7 * i + 3 * j) % 11 - 5) / 10)) + j / 10)"
ORACLES = {
    "full_batch_loss": f"""WITH {ITEMS_SQL}, u AS (SELECT id, {unit_sql("vec")} AS v FROM it),
s AS (SELECT q.id AS query_id, k.id AS key_id, {dot_sql("q.v", "k.v")} AS s FROM u q CROSS JOIN u k WHERE q.id % 50 = 0)
SELECT query_id, round(ln(sum(exp(s))) - max(s) FILTER (key_id = query_id + 1), 6) AS loss FROM s GROUP BY query_id HAVING count(*) FILTER (key_id = query_id + 1) > 0""",
    "quantization_losses": f"WITH {ITEMS_SQL}, e AS (SELECT id, label, len(vec) AS n, {sq('vec', 'list_reverse(vec)')} AS e FROM it) SELECT label, round(sum((1 + id % 3) * e), 4) AS weighted, round(1.25 * sum(e), 4) AS quantization, round(avg(e / n), 4) AS mse FROM e GROUP BY label",
    "squeezed_vectors": f"WITH {ITEMS_SQL} SELECT id AS vec_id, CAST(len(vec) AS INTEGER) AS n, round(vec[1], 6) AS v0, round(vec[64], 6) AS v63 FROM it",
    "feed_forward_scores": f"WITH {ITEMS_SQL}, a AS (SELECT id, list_transform({LAYER.format(n=4, m=64, v='vec')}, lambda x: greatest(x, 0)) AS h FROM it), b AS (SELECT id, {LAYER.format(n=2, m=4, v='h')} AS s FROM a) SELECT id AS vec_id, round(s[1], 6) AS s0, round(s[2], 6) AS s1 FROM b",
    "random_policy": f"WITH n AS (SELECT event_id, unnest(range({number(chr(39) + chr(39) + ' || event_id || ' + chr(39) + '|0|n' + chr(39))} % {episodes.MOST_ACTIONS} + 1)) AS j FROM events) SELECT event_id, string_agg(({POLICY})[{number('event_id || ' + chr(39) + '|0|' + chr(39) + ' || j')} % {len(POLICY)} + 1], ',' ORDER BY j) AS actions FROM n GROUP BY event_id",
    "candidates_reranked": f"WITH {IDENT}, s AS (SELECT *, CASE WHEN length(token) % 2 = 0 THEN length(token) / 10 ELSE 0 END AS signal FROM ident) SELECT token, frequency, round(signal, 6) AS signal, round(score * (1 + signal), 6) AS score, 'identifiers+gradient' AS strategy FROM s",
    "registered_metrics": f"""WITH {ITEMS_SQL}, s AS (SELECT q.id AS query_id, k.id AS key_id, CAST(k.label = q.label AS INTEGER) AS rel, {dot_sql("q.vec", "k.vec")} AS s FROM it q CROSS JOIN it k WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key_id) AS rank FROM s QUALIFY rank <= 20),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM r),
q AS (SELECT query_id, k, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS hits, sum(rel) AS n, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= k THEN rel / log2(ideal + 1.0) ELSE 0 END) AS idcg, min(rank) FILTER (rank <= k AND rel = 1) AS first FROM i, (VALUES (1), (5), (20)) v(k) GROUP BY query_id, k),
m AS (SELECT k, unnest([{{'m': 'recall', 'v': hits / greatest(1, least(n, k))}}, {{'m': 'ndcg', 'v': CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END}}, {{'m': 'precision', 'v': hits / k}}, {{'m': 'hit', 'v': CASE WHEN hits > 0 THEN 1 ELSE 0 END}}, {{'m': 'mrr', 'v': coalesce(1 / first, 0)}}]) AS x FROM q)
SELECT x.m || '@' || k AS name, round(avg(x.v), 6) AS value FROM m GROUP BY x.m, k""",
    "dense_eval_negatives": f"""WITH {ITEMS_SQL}, q AS (SELECT id AS query_id, vec AS qv FROM it WHERE id % 50 = 0), j AS (SELECT *, unnest(range(21)) AS j FROM q),
d AS (SELECT query_id, qv, j, CASE WHEN j = 0 THEN query_id + 1 ELSE 1 + {KEY} % (SELECT max(id) FROM it) END AS key_id FROM j),
s AS (SELECT query_id, j, {dot_sql("qv", "it.vec")} AS score FROM d JOIN it ON it.id = key_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, j) AS rank FROM s),
p AS (SELECT query_id, max(CASE WHEN j = 0 THEN rank END) AS rank FROM r GROUP BY query_id)
SELECT query_id, CAST(k AS INTEGER) AS k, CAST(rank <= k AS DOUBLE) AS recall, round(CAST(rank <= k AS DOUBLE) / log2(rank + 1.0), 6) AS ndcg FROM p, (VALUES (1), (5), (10)) v(k)""",
    "weighted_views": f"WITH {ITEMS_SQL}, w AS (SELECT id, list_transform(range(1, 65), lambda i: {VIEW.format(i='i')}) AS v FROM it), n AS (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-8) AS n FROM w) SELECT id AS vec_id, round(v[1] / n, 6) AS v0, round(v[64] / n, 6) AS v63 FROM n",
    "sibling_sids": f"WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, {PART_SID} AS sid FROM part) SELECT a.p_partkey, a.sid, coalesce(string_agg(DISTINCT b.sid, ',' ORDER BY b.sid), '') AS siblings FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.sid <> b.sid GROUP BY a.p_partkey, a.sid",
    "sampled_subsequences": f"WITH {H}, t AS (SELECT *, CAST(len(seq) * (len(seq) - 1) / 2 AS BIGINT) AS total FROM h), d AS (SELECT *, unnest(range(least(total, 5))) AS pos FROM t), i AS (SELECT *, CASE WHEN total <= 5 THEN pos ELSE {number(chr(117) + 'ser_id || ' + chr(39) + '|' + chr(39) + ' || pos || ' + chr(39) + '|42' + chr(39))} % total END AS i FROM d), e AS (SELECT *, CAST(floor((1 + sqrt(1 + 8.0 * i)) / 2) AS BIGINT) AS e FROM i) SELECT user_id, CAST(pos AS INTEGER) AS pos, array_to_string(seq[i - e * (e - 1) // 2 + 1 : e + 1], ',') AS part FROM e",
    "probe_accuracy": "SELECT source, count(*) AS n, CAST(count(*) FILTER (contains(lower(text), lower(lang))) AS BIGINT) AS correct, round(count(*) FILTER (contains(lower(text), lower(lang))) / count(*), 6) AS accuracy FROM documents GROUP BY source",
    "group_means": f"WITH {ITEMS_SQL} SELECT label, round(avg(vec[1]), 6) AS v0, round(avg(vec[64]), 6) AS v63 FROM it GROUP BY label",
    "gather_places": f"WITH {H}, p AS (SELECT user_id, seq, unnest(range(0, len(seq), 3)) AS col FROM h) SELECT user_id, CAST(col AS INTEGER) AS col, seq[col + 1] AS value FROM p",
    "text_helpers": "SELECT page_id, md5(translate(html, '<>/', '')) AS removed, md5(CASE WHEN contains(html, '<title>') THEN split_part(substr(html, instr(html, '<title>') + 7), '</title>', 1) ELSE '' END) AS title, NOT regexp_matches(url, '\\.[^./]*$') AS bare, CASE WHEN contains(url, '://') THEN substr(url, 1, instr(url, '://') + 2) || 'x' ELSE url END AS cut FROM pages",
    "warmup_cosine": "WITH s AS (SELECT event_id, event_id % 400 AS s FROM events) SELECT event_id, round(CASE WHEN s < 40 THEN s / 40.0 ELSE greatest(0.1, 0.5 * (1 + cos(pi() * least(1.0, (s - 40) / 260.0)))) END, 6) AS factor FROM s",
    "rotation_trick": f"WITH {ITEMS_SQL} SELECT id AS vec_id, round(vec[64], 4) AS v0, round(vec[1], 4) AS v63 FROM it",
    "parquet_round_trip": "SELECT event_id, value * 2 AS double FROM events",
    "json_splits_round_trip": "WITH x AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents) SELECT doc_id, source, CASE WHEN n > 1 AND r <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM x",
    "prediction_rows": f"WITH {H}, p AS (SELECT user_id, unnest(seq) AS prediction, unnest(range(len(seq))) AS i FROM h) SELECT user_id * 1000 + i AS key, prediction FROM p",
}
