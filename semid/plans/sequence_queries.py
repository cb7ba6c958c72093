"""Queries over user histories: a user's events in the order of time and id; an event's item is its id modulo 500, where an item is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.operators import batches as B
from semid.operators import sequences as S
from semid.plans.common import items, joined, r6, table
from semid.plans.quantize_queries import assigned, residual_sql
from semid.plans.sequence_plan import SequencePlan

TYPES = {"click": 1, "view": 2, "purchase": 3}


def histories(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("item", F.pmod("event_id", F.lit(500)))
    return S.user_sequences(events, "user_id", "item", ["ts", "event_id"])


def _of(out):
    return lambda spark, sf_dir: histories(spark, sf_dir).select("user_id", joined(out()).alias("seq"))


def user_sequences(spark, sf_dir):
    return histories(spark, sf_dir).select("user_id", F.size("seq").alias("n"), joined("seq").alias("seq"))


seq_trim_tail = _of(lambda: S.tail(F.col("seq"), 20))
seq_trim_head = _of(lambda: S.head(F.col("seq"), 20))
seq_pad_or_trim = _of(lambda: S.pad_or_trim(F.col("seq"), 60, -1))
seq_attention_mask = _of(lambda: S.attention_mask(S.pad_or_trim(F.col("seq"), 80, -1), -1))
seq_remove_oov = _of(lambda: S.remove_token(F.col("seq"), 7))
last_k_mask = _of(lambda: S.last_k_mask(F.size("seq"), 5, 100))


def seq_min_length_filter(spark, sf_dir):
    return S.longer_than(histories(spark, sf_dir), ["seq"], 65).select("user_id", F.size("seq").alias("n"))


def next_k_labels(spark, sf_dir):
    x = S.longer_than(histories(spark, sf_dir), ["seq"], 4).withColumn("s", S.next_k_labels(F.col("seq"), 3, -9, -1))
    return x.select("user_id", joined("s.input").alias("input"), joined("s.labels").alias("labels"))


def identity_labels(spark, sf_dir):
    return S.identity_labels(histories(spark, sf_dir), "user_id", "seq")


def contiguous_subsequences(spark, sf_dir):
    x = S.contiguous_subsequences(histories(spark, sf_dir), "seq")
    return x.select("user_id", "start", "length", joined("sub").alias("sub"))


def id_to_sid_flatten(spark, sf_dir):
    sids = assigned(spark, sf_dir).select(F.col("id").alias("item_id"), "codes")
    return S.map_to_codes(histories(spark, sf_dir), sids, "user_id", "seq").select("user_id", joined("codes").alias("codes"))


def id_to_embedding(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(500)).alias("item"))
    out = S.map_to_embeddings(events, items(spark, sf_dir), "item", "id", "vec")
    return out.select("event_id", "item", r6(F.get("vec", F.lit(0))).alias("first"), F.size("vec").alias("width"))


def category_to_index_oov(spark, sf_dir):
    mapping = spark.createDataFrame(list(TYPES.items()), "value string, idx int")
    return S.category_index(table(spark, sf_dir, "events").select("event_id", "event_type"), mapping, "event_type")


def category_list_to_index(spark, sf_dir):
    x = S.user_sequences(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return x.select("user_id", joined(S.category_index_list(F.col("seq"), TYPES)).alias("seq"))


def sid_offsets(spark, sf_dir):
    sids = assigned(spark, sf_dir).select(F.col("id").alias("item_id"), "codes")
    x = S.map_to_codes(histories(spark, sf_dir), sids, "user_id", "seq")
    return x.select("user_id", joined(S.level_offsets(F.col("codes"), 2, 8)).alias("codes"))


def sid_separators(spark, sf_dir):
    sids = assigned(spark, sf_dir).select(F.col("id").alias("item_id"), "codes")
    x = S.map_to_codes(histories(spark, sf_dir), sids, "user_id", "seq")
    return x.select("user_id", joined(S.with_separators(F.transform("codes", lambda c: c.cast("bigint")), 2, -1)).alias("codes"))


def user_bin(spark, sf_dir):
    return histories(spark, sf_dir).select("user_id", S.user_bin(F.col("user_id"), 16).alias("bin"))


def _positions(spark, sf_dir):
    items_of = histories(spark, sf_dir).select("user_id", F.posexplode("seq").alias("pos", "item"))
    return S.map_to_embeddings(items_of, items(spark, sf_dir), "item", "id", "vec")


def last_k_mean_pool(spark, sf_dir):
    out = S.pooled(_positions(spark, sf_dir), "user_id", "pos", "vec", 64, "mean", 5)
    return out.select("user_id", r6(F.get("pooled", F.lit(0))).alias("p0"), r6(F.get("pooled", F.lit(63))).alias("p63"))


def first_last_pool(spark, sf_dir):
    rows = _positions(spark, sf_dir)
    a, b = S.pooled(rows, "user_id", "pos", "vec", 64, "first"), S.pooled(rows, "user_id", "pos", "vec", 64, "last")
    return a.select("user_id", r6(F.get("pooled", F.lit(0))).alias("first0")).join(b.select("user_id", r6(F.get("pooled", F.lit(0))).alias("last0")), "user_id")


def subtoken_vectors(spark, sf_dir):
    """New tokens from sub-token vectors with weights 0.5**j; token 0 has none and gets the global mean."""
    old = items(spark, sf_dir).select("id", "vec")
    tokens = spark.range(50).select(F.concat(F.lit("t"), "id").alias("token"), F.filter(F.array("id", F.col("id") * 2, F.col("id") * 3), lambda x: x > 0).alias("ids"))
    out = S.subtoken_means(tokens, old, 64, 0.5)
    return out.select("token", r6(F.get("vec", F.lit(0))).alias("v0"), r6(F.get("vec", F.lit(1))).alias("v1"))


def declared_sequence_plan(spark, sf_dir):
    plan = SequencePlan(id_col="user", rename={"user_id": "user", "seq": "history"}, types={"history": "bigint"}, least=55, length=50, padding=-1, unknown=7)
    return plan.build(histories(spark, sf_dir)).select("user", joined("history").alias("history"))


def collated_batches(spark, sf_dir):
    """Histories without item 7, their last 60 items, in batches of 16 of near length; a row for each place of a batch."""
    out = B.batch_lines(B.collated(histories(spark, sf_dir), "user_id", ["seq"], batch_rows=16, length=60, pad=-1, oov=7), ["seq", "mask"])
    return out.select("batch_id", "slot", F.col("key").alias("user_id"), "width", joined("seq").alias("seq"), joined("mask").alias("mask"))


def stacked_items(spark, sf_dir):
    out = B.stacked(items(spark, sf_dir), "id", {"vec": "embedding", "label": "category"}, batch_rows=32)
    return B.batch_lines(out.withColumn("width", F.size("keys")), ["embedding", "category"]).select("batch_id", "slot", F.col("key").alias("id"), "width", r6(F.get("embedding", F.lit(0))).alias("v0"), "category")


NAMES = "collated_batches stacked_items user_sequences seq_trim_tail seq_trim_head seq_pad_or_trim seq_attention_mask seq_remove_oov seq_min_length_filter next_k_labels identity_labels contiguous_subsequences id_to_sid_flatten id_to_embedding category_to_index_oov category_list_to_index sid_offsets sid_separators user_bin last_k_mask last_k_mean_pool first_last_pool subtoken_vectors declared_sequence_plan".split()
QUERIES = {n: globals()[n] for n in NAMES}

H = "h AS (SELECT user_id, list(event_id % 500 ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
J = "array_to_string({0}, ',')"
PAD = "list_concat(s, list_transform(range({0} - len(s)), lambda i: -1))"
P = f"{H}, p AS (SELECT user_id, unnest(seq) AS item, unnest(range(len(seq))) AS pos FROM h)"
V = "v AS (SELECT vec_id AS item, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"
CODES = f"WITH {residual_sql()}, {P}, c AS (SELECT user_id, pos, c1, c2 FROM p JOIN a ON a.id = p.item)"


def _map(expr):
    return f"WITH {H} SELECT user_id, {J.format(expr)} AS seq FROM h"


ORACLES = {
    "collated_batches": f"""WITH {H}, c AS (SELECT user_id, list_filter(seq, lambda x: x <> 7) AS f FROM h), t AS (SELECT user_id, f[greatest(len(f) - 59, 1):] AS s FROM c),
        o AS (SELECT *, row_number() OVER (ORDER BY len(s), md5(user_id || '|42'), user_id) - 1 AS place FROM t), b AS (SELECT *, place // 16 AS batch_id, place % 16 AS slot FROM o), w AS (SELECT *, max(len(s)) OVER (PARTITION BY batch_id) AS width FROM b)
        SELECT batch_id, CAST(slot AS INTEGER) AS slot, user_id, CAST(width AS INTEGER) AS width, {J.format(PAD.format("width"))} AS seq, array_to_string(list_transform(range(width), lambda i: CASE WHEN i < len(s) THEN 1 ELSE 0 END), ',') AS mask FROM w""",
    "stacked_items": """WITH o AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id || '|42'), vec_id) - 1 AS place FROM embeddings), b AS (SELECT *, place // 32 AS batch_id FROM o)
        SELECT batch_id, CAST(place % 32 AS INTEGER) AS slot, vec_id AS id, CAST(count(*) OVER (PARTITION BY batch_id) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS v0, label AS category FROM b""",
    "user_sequences": f"WITH {H} SELECT user_id, CAST(len(seq) AS INTEGER) AS n, {J.format('seq')} AS seq FROM h",
    "seq_trim_tail": _map("seq[greatest(len(seq) - 19, 1):]"),
    "seq_trim_head": _map("seq[1:20]"),
    "seq_pad_or_trim": f"WITH {H}, t AS (SELECT user_id, seq[greatest(len(seq) - 59, 1):] AS s FROM h) SELECT user_id, {J.format(PAD.format(60))} AS seq FROM t",
    "seq_attention_mask": f"WITH {H}, t AS (SELECT user_id, seq[greatest(len(seq) - 79, 1):] AS s FROM h) SELECT user_id, {J.format('list_transform(' + PAD.format(80) + ', lambda x: CASE WHEN x <> -1 THEN 1 ELSE 0 END)')} AS seq FROM t",
    "seq_remove_oov": _map("list_filter(seq, lambda x: x <> 7)"),
    "last_k_mask": _map("list_transform(range(100), lambda i: CASE WHEN i < len(seq) AND i >= len(seq) - 5 THEN 1 ELSE 0 END)"),
    "seq_min_length_filter": f"WITH {H} SELECT user_id, CAST(len(seq) AS INTEGER) AS n FROM h WHERE len(seq) >= 65",
    "next_k_labels": f"WITH {H} SELECT user_id, {J.format('list_concat(seq[1:len(seq) - 3], [-9, -1, -1])')} AS input, {J.format('seq[len(seq) - 2:]')} AS labels FROM h WHERE len(seq) >= 4",
    "identity_labels": f"WITH {P} SELECT user_id, CAST(pos AS INTEGER) AS col, item AS label FROM p",
    "contiguous_subsequences": f"WITH {H}, a AS (SELECT user_id, seq, unnest(range(1, len(seq))) AS a FROM h), b AS (SELECT user_id, seq, a, unnest(range(2, len(seq) - a + 2)) AS b FROM a) SELECT user_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS length, {J.format('seq[a:a + b - 1]')} AS sub FROM b",
    "id_to_sid_flatten": f"{CODES} SELECT user_id, string_agg(c1 || ',' || c2, ',' ORDER BY pos) AS codes FROM c GROUP BY user_id",
    "id_to_embedding": f"WITH {V} SELECT event_id, event_id % 500 AS item, round(vec[1], 6) AS first, CAST(len(vec) AS INTEGER) AS width FROM events JOIN v ON v.item = event_id % 500",
    "category_to_index_oov": "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS idx FROM events",
    "category_list_to_index": "SELECT user_id, string_agg(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END, ',' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id",
    "sid_offsets": f"{CODES} SELECT user_id, string_agg(c1 || ',' || (c2 + 8), ',' ORDER BY pos) AS codes FROM c GROUP BY user_id",
    "sid_separators": f"{CODES} SELECT user_id, string_agg(c1 || ',' || c2 || ',-1', ',' ORDER BY pos) AS codes FROM c GROUP BY user_id",
    "user_bin": "SELECT DISTINCT user_id, user_id % 16 AS bin FROM events",
    "last_k_mean_pool": f"WITH {P}, {V}, k AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM p) SELECT user_id, round(sum(vec[1]) / count(*), 6) AS p0, round(sum(vec[64]) / count(*), 6) AS p63 FROM k JOIN v USING (item) WHERE r <= 5 GROUP BY user_id",
    "first_last_pool": f"WITH {P}, {V} SELECT user_id, round(arg_min(vec, pos)[1], 6) AS first0, round(arg_max(vec, pos)[1], 6) AS last0 FROM p JOIN v USING (item) GROUP BY user_id",
    "subtoken_vectors": f"WITH {V}, t AS (SELECT 't' || r.range AS token, list_filter([r.range, r.range * 2, r.range * 3], lambda x: x > 0) AS ids FROM range(50) r), e AS (SELECT token, unnest(ids) AS item, unnest(range(len(ids))) AS j FROM t), s AS (SELECT token, sum(vec[1] * pow(0.5, j)) / sum(pow(0.5, j)) AS v0, sum(vec[2] * pow(0.5, j)) / sum(pow(0.5, j)) AS v1 FROM e JOIN v USING (item) GROUP BY token), m AS (SELECT avg(vec[1]) AS m0, avg(vec[2]) AS m1 FROM v) SELECT token, round(coalesce(v0, m0), 6) AS v0, round(coalesce(v1, m1), 6) AS v1 FROM t LEFT JOIN s USING (token), m",
    "declared_sequence_plan": f"WITH {H}, f AS (SELECT user_id, list_filter(seq, lambda x: x <> 7) AS q FROM h WHERE len(seq) >= 55), t AS (SELECT user_id, q[greatest(len(q) - 49, 1):] AS s FROM f) SELECT user_id AS user, {J.format(PAD.format(50))} AS history FROM t",
}
