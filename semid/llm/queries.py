"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import encode
from .common import table
from .exact_dedup import exact_groups
from .line_dedup import dedup_lines
from .near_dedup import near_groups
from .packing import pack
from .pseudonyms import pseudonymize
from .quality_rules import DecisionList, fit, judge
from .resampling import resample
from .secret_scan import BASE, RULES, scan_report
from .sharding import shard_rows
from .token_counts import token_counts
from .warc_zip import archive_round_trip
from .whitening import fit as fit_whitener
from .whitening import identity_error, whiten


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), key="semid")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), least_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which need no learned list: these SQL can say."""
    out = judge(table(spark, sf_dir, "documents"), DecisionList(()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j.range) AS n FROM rep, range(5) j GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, stored=True)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitener(vectors)
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op1_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, string_split_regex(t, {_quoted(r.pattern)}) AS p, regexp_extract_all(t, {_quoted(r.pattern)}, 0) AS m,"
        f" regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS g, {r.least} AS least FROM d WHERE regexp_matches(t, {_quoted(r.pattern)})"
        for k, r in enumerate(RULES)
    )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    joined = f"string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, k, i.least, length(g[i]) AS size, length(m[i]) AS n,
        CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM i),
v AS (SELECT doc_id, k, s, s + n AS e FROM s WHERE size >= least),
a AS (SELECT doc_id, {counts}, {joined} AS spans, {joined.replace("ORDER BY s, k, e)", "ORDER BY s, k, e) FILTER (k < " + str(len(BASE)) + ")")} AS base FROM v GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), '') AS bits FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
"""

OP12_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
#: The checksum is worked out once for each different feature, byte by byte.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {OP12_WORDS} AS w FROM documents),
f AS (SELECT doc_id, {OP12_RUNS} AS g FROM d),
b AS (SELECT {OP12_RUNS} AS g FROM (SELECT {OP12_WORDS} AS w FROM benchmark)),
u AS (SELECT g, hex(g) AS h FROM (SELECT g FROM f UNION SELECT g FROM b)),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
c AS (SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, tb[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS k FROM u, tab),
fk AS (SELECT doc_id, k FROM f JOIN c USING (g)),
s AS (SELECT k, CAST(count(*) AS DOUBLE) AS n FROM fk GROUP BY k),
t AS (SELECT k, CAST(count(*) AS DOUBLE) AS n FROM b JOIN c USING (g) GROUP BY k),
gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS v FROM s LEFT JOIN t ON s.k = t.k),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM fk JOIN gain USING (k) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id) AS place, count(*) FILTER (enough) OVER () AS many FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= many * 25 // 100 THEN place END AS rank FROM r
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op3_warc_zip": op3_warc_zip,
    "op4_pseudonyms": op4_pseudonyms,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "quality_base_counts": quality_base_counts,
    "op8_packing": op8_packing,
    "op9_bpe_words": op9_bpe_words,
    "op10_near_dedup": op10_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op11_hash_ring": op11_hash_ring,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op1_secret_scan": _op1_sql(),
    "op3_warc_zip": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op12_importance_resampling": OP12_SQL,
    "quality_base_counts": QUALITY_SQL,
}
