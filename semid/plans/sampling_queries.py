"""Queries of deterministic samples and splits; all draws come from md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.operators import sampling as S
from semid.plans.common import joined, table

WEIGHTS = {"en": 0.4, "fr": 0.3, "de": 0.2}
RATIOS = {"raw": 0.7, "sid_header": 0.2, "sid_replace": 0.1}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def stratified_split(spark, sf_dir):
    return S.stratified_split(_docs(spark, sf_dir), "source", "doc_id", 0.1).select("doc_id", "source", "split")


def weighted_resample(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return S.resample(docs, "lang", "doc_id", S.weighted_targets(docs, "lang", WEIGHTS)).select("lang", "slot", "doc_id")


def mix_resample(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return S.resample(docs, "lang", "doc_id", S.mix_targets(docs, "lang", WEIGHTS), 7).select("lang", "slot", "doc_id")


def format_bucket(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.ratio_bucket("doc_id", RATIOS, "raw").alias("format"))


def fim_render(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(S.fill_in_middle(F.col("text"), F.col("doc_id"))).alias("digest"))


def mask_tokens(spark, sf_dir):
    n = F.size(F.split("text", " "))
    return _docs(spark, sf_dir).select("doc_id", joined(S.masked_places(n, F.col("doc_id"))).alias("places"))


def hash_shuffle_limit(spark, sf_dir):
    """A sample of 100 rows: the operator's limit."""
    return S.shuffled(_docs(spark, sf_dir).select("doc_id"), "doc_id", 42, 100)


def top_half_events(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return S.top_half(users, "n", "user_id")


def interleave_counts(spark, sf_dir):
    x = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return x.select("lang", "n", S.interleave_count(F.col("n"), 0.25).cast("bigint").alias("more"))


def _interleaved(spark, sf_dir, fraction):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return S.interleaved(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "doc_id", fraction).select("place", "doc_id", "lang", "slot")


def interleaved_examples(spark, sf_dir):
    """Other languages as a fifth of all: fewer than there are."""
    return _interleaved(spark, sf_dir, 0.2)


def interleaved_with_repeats(spark, sf_dir):
    """Other languages as four fifths: more than there are."""
    return _interleaved(spark, sf_dir, 0.8)


def _interleaved_sql(fraction):
    return f"""WITH m AS (SELECT doc_id, lang FROM documents WHERE lang = 'en'), o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents WHERE lang <> 'en'),
        w AS (SELECT CAST(trunc((SELECT count(*) FROM m) * CAST({fraction} AS DOUBLE) / (1 - CAST({fraction} AS DOUBLE))) AS BIGINT) AS w, (SELECT count(*) FROM o) AS n),
        d AS (SELECT doc_id, lang, 0 AS slot FROM o, w WHERE w <= n AND r <= w UNION ALL SELECT doc_id, lang, slot FROM (SELECT CAST(unnest(range(w)) AS BIGINT) AS slot, n FROM w WHERE w > n) s JOIN o ON r = CAST('0x' || substr(md5('slot|' || slot || '|42'), 1, 12) AS BIGINT) % n + 1),
        b AS (SELECT doc_id, lang, 0 AS slot, 0 AS f FROM m UNION ALL SELECT doc_id, lang, slot, 1 FROM d)
        SELECT row_number() OVER (ORDER BY md5(doc_id || '|' || slot || '|' || f || '|42'), f, doc_id, slot) AS place, doc_id, lang, CAST(slot AS BIGINT) AS slot FROM b"""


NAMES = "interleaved_examples interleaved_with_repeats stratified_split weighted_resample mix_resample format_bucket fim_render mask_tokens hash_shuffle_limit top_half_events interleave_counts".split()
QUERIES = {n: globals()[n] for n in NAMES}


def number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


def resample_sql(target: str, seed: int) -> str:
    return f"""WITH s AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 0.4 WHEN 'fr' THEN 0.3 WHEN 'de' THEN 0.2 ELSE 0.0 END AS w FROM documents GROUP BY lang),
t AS (SELECT lang, n, CAST(floor(CAST({target} AS DOUBLE)) AS BIGINT) AS target FROM s),
k AS (SELECT lang, unnest(range(target)) AS slot, n FROM t),
d AS (SELECT lang, slot, {number(f"lang || '|' || slot || '|{seed}'")} % n AS r FROM k),
r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents)
SELECT lang, slot, doc_id FROM d JOIN r USING (lang, r)"""


A = f"({number('doc_id || ' + chr(39) + '|42a' + chr(39))} % length(text))"
B = f"(({A} + 1 + {number('doc_id || ' + chr(39) + '|42b' + chr(39))} % (length(text) - 1)) % length(text))"
ORACLES = {
    "interleaved_examples": _interleaved_sql(0.2),
    "interleaved_with_repeats": _interleaved_sql(0.8),
    "stratified_split": "WITH x AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents) SELECT doc_id, source, CASE WHEN n > 1 AND r <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM x",
    "weighted_resample": resample_sql("(SELECT sum(n) FROM s) * CAST(w AS DOUBLE)", 42),
    "mix_resample": resample_sql("(SELECT max(n) FROM s) * CAST(w AS DOUBLE) / (SELECT sum(CAST(w AS DOUBLE)) FROM s) * (SELECT count(*) FROM s)", 7),
    "format_bucket": f"WITH x AS (SELECT doc_id, {number(chr(34) + 'k' + chr(34))} % 1000 AS s FROM (SELECT doc_id, doc_id || '|' AS k FROM documents)) SELECT doc_id, CASE WHEN s < 700 THEN 'raw' WHEN s < 900 THEN 'sid_header' WHEN s < 1000 THEN 'sid_replace' ELSE 'raw' END AS format FROM x",
    "fim_render": f"WITH x AS (SELECT doc_id, text, least({A}, {B}) AS lo, greatest({A}, {B}) AS hi FROM documents) SELECT doc_id, md5(CASE WHEN length(text) < 16 THEN text ELSE '<FIM_PREFIX>' || substr(text, 1, lo) || '<FIM_SUFFIX>' || substr(text, hi + 1) || '<FIM_MIDDLE>' || substr(text, lo + 1, hi - lo) END) AS digest FROM x",
    "mask_tokens": f"WITH x AS (SELECT doc_id, len(string_split(text, ' ')) AS n, 300000 + 400 * ({number('doc_id || ' + chr(39) + '|42r' + chr(39))} % 1000) AS rate FROM documents), i AS (SELECT doc_id, n, rate, unnest(range(n)) AS i FROM x), e AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '|' || i || '|42'), i) AS r, n * rate // 1000000 AS k FROM i) SELECT doc_id, coalesce(string_agg(i, ',' ORDER BY i) FILTER (r <= k), '') AS places FROM e GROUP BY doc_id",
    "hash_shuffle_limit": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100",
    "top_half_events": "WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT * FROM u ORDER BY n DESC, user_id LIMIT (SELECT greatest(1, count(*) // 2) FROM u)",
    "interleave_counts": "SELECT lang, count(*) AS n, CAST(floor(count(*) * CAST(0.25 AS DOUBLE) / 0.75) AS BIGINT) AS more FROM documents GROUP BY lang",
}
ORACLES["format_bucket"] = ORACLES["format_bucket"].replace('"k"', "k")
