"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.functions import text as T
from semid.operators.encoding import encoded
from semid.operators.sampling import ranked
from semid.plans.common import joined, r6, table
from semid.plans.quantize_queries import assigned, residual_sql
from semid.session import stored


#: The reduction of tokens that is aimed at.
TARGET = 0.25


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def mine_identifiers(spark, sf_dir):
    return T.mine_identifiers(_docs(spark, sf_dir)).select("token", "frequency", "current_subtokens", "score")


def fallback_tokenize_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.piece_count(F.col("text")).alias("pieces"))


def mine_ngrams(spark, sf_dir):
    return T.mine_ngrams(_docs(spark, sf_dir)).select("token", "frequency", "current_subtokens", "score")


def _merged(spark, sf_dir, identifiers_first: bool):
    a, b = (stored(x, "candidates") for x in (T.mine_identifiers(_docs(spark, sf_dir)), T.mine_ngrams(_docs(spark, sf_dir))))
    return T.merge_candidates(a, b) if identifiers_first else T.merge_candidates(b, a)


def candidates_merge_v(spark, sf_dir):
    """Identifiers win over n-grams."""
    return _merged(spark, sf_dir, True).groupBy("strategy").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def candidates_merge_r(spark, sf_dir):
    """N-grams win over identifiers."""
    return _merged(spark, sf_dir, False).groupBy("strategy").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def top_n_tokens(spark, sf_dir):
    """A top-k report."""
    return T.top_tokens(T.mine_identifiers(_docs(spark, sf_dir)), 128).select("token", "score")


def compression_by_language(spark, sf_dir):
    """Fallback pieces against whole words, a language's rows and the total by one rollup."""
    x = _docs(spark, sf_dir).select("lang", T.piece_count(F.col("text")).cast("bigint").alias("b"), T.word_count(F.col("text")).cast("bigint").alias("a"))
    return x.rollup("lang").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "before", "after", r6(F.col("after") / F.col("before")).alias("ratio"), r6(100 * (1 - F.col("after") / F.col("before"))).alias("reduction"), (1 - F.col("after") / F.col("before") >= TARGET).alias("met"))


def bytes_per_token(spark, sf_dir):
    x = _docs(spark, sf_dir).select("source", F.octet_length("text").cast("bigint").alias("bytes"), T.piece_count(F.col("text")).cast("bigint").alias("tokens"))
    return x.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).withColumn("bytes_per_token", r6(F.col("bytes") / F.col("tokens")))


def ratio_percentiles(spark, sf_dir):
    """Median of the known ratios, and the element at min(n - 1, int(0.95 n)) of all sorted ratios, per source: positions come from ranks, no list is gathered.

    A text without pieces has the ratio NaN, which is greater than any number; no text has no ratio, and stands last.
    """
    words, pieces = T.word_count(F.col("text")), T.piece_count(F.col("text"))
    ratio = F.when(pieces > 0, words / pieces).when(pieces == 0, F.lit(float("nan")))
    x = stored(_docs(spark, sf_dir).select("source", "doc_id", ratio.alias("ratio")), "ratios")
    known = x.groupBy(F.col("source").alias("_source")).agg(F.count("ratio").alias("known"))
    y = ranked(x, "source", [F.asc_nulls_last("ratio"), "doc_id"], "r").withColumns({"i": F.col("r") - 1, "n": F.col("r_n")})
    y = y.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))  # a row for each source
    value = lambda at: F.max(F.when(F.col("i") == at, F.col("ratio")))
    middle = (value(F.floor((F.col("known") - 1) / 2)) + value(F.floor(F.col("known") / 2))) / 2
    return y.groupBy("source").agg(r6(middle).alias("median"), r6(value(F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n"))))).alias("p95"))


def surface_occurrences(spark, sf_dir):
    """Tokens a new surface would save, one an occurrence, and by its sub-tokens."""
    x = _docs(spark, sf_dir).select("doc_id", T.occurrences(F.col("text"), F.lit("ation")).alias("n"))
    sub = T.subtokens(F.lit("ation"))
    return x.select("doc_id", "n", (F.col("n") * (sub - 1)).cast("bigint").alias("by_subtokens"))


def letter_encoder():
    """A stand-in for a neural encoder: a text's numbers of characters, of e and of blanks."""
    return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]


def encoded_texts(spark, sf_dir):
    """Texts by a plugged-in encoder."""
    out = encoded(_docs(spark, sf_dir).select("doc_id", "text"), "text", letter_encoder)
    return out.select("doc_id", *[r6(F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(3)])


def hash_embed(spark, sf_dir):
    """256 dimensions of hashed word trigrams, for the documents: the largest entry and the entries in use."""
    v = T.hash_vector(F.col("text"), 256)
    return _docs(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", r6(F.array_max("v")).alias("top"), F.size(F.filter("v", lambda x: x > 0)).alias("used"), joined(F.transform("v", lambda x: (x > 0).cast("int")), "").alias("places"))


def chunk_lines(spark, sf_dir):
    chunks = T.chunk_lines(F.col("text"), 400, F.concat(F.lit("# "), F.col("source"), F.lit("\n")))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def chunk_lines_close(spark, sf_dir):
    chunks = T.chunk_lines(F.col("text"), 400, close_at_most=True)
    return _docs(spark, sf_dir).select("doc_id", F.size(chunks).alias("chunks"), F.length(F.array_join(chunks, "")).alias("n"))


def wiki_clean(spark, sf_dir):
    marked = F.concat(F.lit("== Title of "), F.col("source"), F.lit(" ==\n* '''bold''' and ''thin'' [[Page|name]] [[plain]] {{drop}}\n<ref a>gone</ref>"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.wiki_to_markdown(marked)).alias("digest"))


def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.compact_slug(F.col("url")).alias("compact"), T.drop_extension(F.col("url")).alias("stem"))


def sid_token_format(spark, sf_dir):
    return assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), T.sid_sequence(F.col("codes"), 2).alias("sequence"), T.sid_sequence(F.col("codes"), 2, False).alias("inline"))


def sid_token_parse(spark, sf_dir):
    tokens = T.special_tokens(T.sid_sequence(F.col("codes"), 2))
    x = assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(tokens).alias("pos", "token"))
    return x.withColumn("p", T.parse_sid(F.col("token"))).select("vec_id", "pos", F.col("p.level").alias("level"), F.col("p.code").alias("code"))


def sid_vocab(spark, sf_dir):
    return T.sid_vocabulary(spark, 3, 64)


def training_formats(spark, sf_dir):
    body = F.col("text")
    x = _docs(spark, sf_dir)
    return x.select("doc_id", F.md5(T.header_format(body, F.lit("go"), F.lit("<SID_L1_00>"))).alias("header"), F.md5(T.replace_first(body, F.lit("the"), F.lit("<X>"))).alias("replaced"), F.md5(T.entity_to_sid(body, F.lit("<SID_L1_00>"))).alias("entity"), F.md5(T.sid_completion(F.lit("python"), F.col("source"), F.array(F.lit("a"), F.lit("b")), F.col("lang"), body)).alias("completion"))


NAMES = "encoded_texts mine_identifiers fallback_tokenize_counts mine_ngrams candidates_merge_v candidates_merge_r top_n_tokens compression_by_language bytes_per_token ratio_percentiles surface_occurrences hash_embed chunk_lines chunk_lines_close wiki_clean html_strip slugify sid_token_format sid_token_parse sid_vocab training_formats".split()
QUERIES = {n: globals()[n] for n in NAMES}

SPACES = r"[\s\x0b\x85\xa0\p{Z}]+"
ENDS = r"[\s\x0b\x1c-\x1f\x85\xa0\p{Z}]+"


def pieces_sql(text: str) -> str:
    """Case changes get a space first, as the engine's patterns have no look-ahead."""
    runs = rf"list_filter(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9\s]|\s+'), lambda r: trim(regexp_replace(r, '\s', '', 'g')) <> '')"
    camel = r"CASE WHEN regexp_matches(r, '[A-Za-z0-9]') THEN regexp_extract_all(regexp_replace(r, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') ELSE [r] END"
    return f"flatten(list_transform(flatten(list_transform({runs}, lambda r: {camel})), lambda p: list_transform(range(0, CAST((length(p) + 3) // 4 AS BIGINT)), lambda i: substr(p, i * 4 + 1, 4))))"


PIECES = f"pc AS (SELECT *, {pieces_sql('text')} AS p FROM documents)"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> ''))"
IDENT = f"""i0 AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents),
i1 AS (SELECT token, count(*) AS frequency FROM i0 GROUP BY token HAVING count(*) >= 5 AND length(token) >= 3),
i2 AS (SELECT token, frequency, CAST(len({pieces_sql('token')}) AS INTEGER) AS current_subtokens FROM i1),
ident AS (SELECT *, frequency * current_subtokens AS score FROM i2 WHERE current_subtokens > 1)"""
NGRAM = f"""{PIECES},
g0 AS (SELECT p[i.range:i.range + n - 1] AS g FROM pc, (VALUES (2), (3)) v(n), LATERAL (SELECT unnest(range(1, len(p) - n + 2)) AS range) i),
g1 AS (SELECT g, count(*) AS frequency FROM g0 GROUP BY g HAVING count(*) >= 25),
g2 AS (SELECT regexp_replace(translate(array_to_string(g, ''), 'Ġ▁', '  '), '^{ENDS}|{ENDS}$', '', 'g') AS token, frequency, CAST(len(g) AS INTEGER) AS k FROM g1),
g3 AS (SELECT * FROM g2 WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[A-Za-z_][A-Za-z0-9_]*')),
g4 AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY frequency DESC, k DESC) AS rn FROM g3),
ngram AS (SELECT token, frequency, k AS current_subtokens, frequency * k AS score FROM g4 WHERE rn = 1)"""


def merge_sql(first: str, second: str) -> str:
    names = {"ident": "identifiers", "ngram": "ngrams"}
    return f"WITH {IDENT}, {NGRAM} SELECT '{names[first]}' AS strategy, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM {first} UNION ALL SELECT '{names[second]}', count(*), CAST(sum(score) AS BIGINT) FROM {second} WHERE token NOT IN (SELECT token FROM {first})"


WIKI = "'== Title of ' || source || ' ==' || chr(10) || '* ''''''bold'''''' and ''''thin'''' [[Page|name]] [[plain]] {{drop}}' || chr(10) || '<ref a>gone</ref>' || text"


def wiki_sql(x: str) -> str:
    rules = [(r"\{\{[^{}]*\}\}", "", "g"), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1", "g"), ("''''''(.+?)''''''", r"**\1**", "g"), ("''''(.+?)''''", r"*\1*", "g"), *[(rf"(?m)^{'=' * n}\s*(.+?)\s*{'=' * n}", rf"{'#' * n} \1", "g") for n in range(6, 1, -1)], (r"(?m)^\*\s*", "- ", "g"), ("(?s)<ref[^>]*>.*?</ref>", "", "g"), ("<[^>]+>", "", "g")]
    for pattern, new, flag in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', '{flag}')"
    return rf"trim(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')"
SID = "'<SID_L1_' || lpad(CAST(c1 AS VARCHAR), 2, '0') || '>', '<SID_L2_' || lpad(CAST(c2 AS VARCHAR), 2, '0') || '>'"
def _chunks_sql(head: str, full: str) -> str:
    """Lines put in chunks one after the other: ``full`` says when a line begins the next chunk."""
    return f"""WITH RECURSIVE x AS (SELECT doc_id, {head} AS head, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS ls FROM documents),
        l AS (SELECT doc_id, head, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM x),
        r AS (SELECT doc_id, i, 0 AS pos, length(head) + length(line) AS size FROM l WHERE i = 1
          UNION ALL SELECT l.doc_id, l.i, CASE WHEN {full} THEN pos + 1 ELSE pos END, CASE WHEN {full} THEN length(head) ELSE size END + length(line) FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
        c AS (SELECT doc_id, pos, any_value(head) || string_agg(line, '' ORDER BY i) AS chunk FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, pos)"""


ORACLES = {
    "chunk_lines": f"""{_chunks_sql("'# ' || source || chr(10)", "size + length(line) > 400")} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(chunk) AS INTEGER) AS n, md5(chunk) AS digest FROM c""",
    "chunk_lines_close": f"""{_chunks_sql("''", "size >= 400")} SELECT d.doc_id, CAST(count(c.pos) AS INTEGER) AS chunks, CAST(coalesce(sum(length(chunk)), 0) AS INTEGER) AS n FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    "encoded_texts": """WITH x AS (SELECT doc_id, [CAST(length(text) AS DOUBLE), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))] AS v FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        n AS (SELECT doc_id, v, greatest(sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]), 1e-12) AS n FROM x) SELECT doc_id, round(v[1] / n, 6) AS v0, round(v[2] / n, 6) AS v1, round(v[3] / n, 6) AS v2 FROM n""",
    "mine_identifiers": f"WITH {IDENT} SELECT token, frequency, current_subtokens, score FROM ident",
    "fallback_tokenize_counts": f"WITH {PIECES} SELECT doc_id, CAST(len(p) AS INTEGER) AS pieces FROM pc",
    "mine_ngrams": f"WITH {NGRAM} SELECT * FROM ngram",
    "candidates_merge_v": merge_sql("ident", "ngram"),
    "candidates_merge_r": merge_sql("ngram", "ident"),
    "top_n_tokens": f"WITH {IDENT} SELECT token, score FROM ident ORDER BY score DESC, token LIMIT 128",
    "compression_by_language": f"WITH {PIECES}, x AS (SELECT lang, len(p) AS b, {WORDS} AS a FROM pc) SELECT coalesce(lang, 'all') AS lang, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, round(sum(a) / sum(b), 6) AS ratio, round(100 * (1 - sum(a) / sum(b)), 6) AS reduction, 1 - sum(a) / sum(b) >= {TARGET} AS met FROM x GROUP BY ROLLUP (lang)",
    "bytes_per_token": f"WITH {PIECES} SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(p)) AS BIGINT) AS tokens, round(sum(strlen(text)) / sum(len(p)), 6) AS bytes_per_token FROM pc GROUP BY source",
    "ratio_percentiles": f"WITH {PIECES}, x AS (SELECT source, {WORDS} / len(p) AS ratio FROM pc) SELECT source, round(median(ratio), 6) AS median, round(list_sort(list(ratio))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1], 6) AS p95 FROM x GROUP BY source",
    "surface_occurrences": "SELECT doc_id, CAST((length(text) - length(replace(text, 'ation', ''))) / 5 AS BIGINT) AS n, CAST((length(text) - length(replace(text, 'ation', ''))) / 5 AS BIGINT) AS by_subtokens FROM documents",
    "hash_embed": f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '') AS ws FROM documents), h AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: CAST('0x' || right(md5(array_to_string(ws[i:i + 2], ' ')), 2) AS INTEGER))) AS d FROM w), c AS (SELECT doc_id, d, count(*) AS n FROM h GROUP BY ALL), e AS (SELECT b.doc_id, r.range AS d, coalesce(n, 0) AS n FROM documents b CROSS JOIN range(256) r LEFT JOIN c ON c.doc_id = b.doc_id AND c.d = r.range) SELECT doc_id, round(max(n) / sqrt(sum(n * n)), 6) AS top, CAST(count(*) FILTER (n > 0) AS INTEGER) AS used, string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY d) AS places FROM e GROUP BY doc_id",
    "wiki_clean": f"SELECT doc_id, md5({wiki_sql(WIKI)}) AS digest FROM documents",
    "html_strip": f"SELECT page_id, md5(trim({HTML}, ' ')) AS digest FROM pages",
    "slugify": rf"SELECT page_id, lower(trim(regexp_replace(url, '{T.SLUG}', '_', 'g'), '_')) AS slug, lower(regexp_replace(url, '{T.COMPACT_SLUG}', '', 'g')) AS compact, regexp_replace(url, '\.[^./]*$', '') AS stem FROM pages",
    "sid_token_format": f"WITH {residual_sql()} SELECT id AS vec_id, '<SID_START>' || array_to_string([{SID}], '<SID_SEP>') || '<SID_END>' AS sequence, array_to_string([{SID}], '') AS inline FROM a",
    "sid_token_parse": f"WITH {residual_sql()}, t AS (SELECT id AS vec_id, unnest([NULL, 0, NULL, 1, NULL]) AS level, unnest([NULL, c1, NULL, c2, NULL]) AS code, unnest(range(5)) AS pos FROM a) SELECT vec_id, CAST(pos AS INTEGER) AS pos, level, code FROM t",
    "sid_vocab": "WITH t AS (SELECT CAST(range AS INTEGER) AS idx, CAST(range // 64 AS INTEGER) AS level, CAST(range % 64 AS INTEGER) AS code FROM range(192)), s(idx, token, kind) AS (VALUES (192, '<SID_START>', 'structural'), (193, '<SID_SEP>', 'structural'), (194, '<SID_END>', 'structural'), (195, '<PREDICT_SID>', 'task'), (196, '<SID_TO_SIG>', 'task'), (197, '<FIM_PREFIX>', 'task'), (198, '<FIM_SUFFIX>', 'task'), (199, '<FIM_MIDDLE>', 'task')) SELECT idx, '<SID_L' || (level + 1) || '_' || lpad(CAST(code AS VARCHAR), 2, '0') || '>' AS token, level, code, 'level' AS kind FROM t UNION ALL SELECT idx, token, NULL, NULL, kind FROM s",
    "training_formats": "SELECT doc_id, md5('// <SID_L1_00>' || chr(10) || text) AS header, md5(CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || '<X>' || substr(text, instr(text, 'the') + 3) ELSE text END) AS replaced, md5('<PREDICT_SID> ' || text || chr(10) || '<SID_L1_00>') AS entity, md5('# class ' || source || ' methods: a, b' || chr(10) || '<FIM_PREFIX>' || lang || '<FIM_SUFFIX><FIM_MIDDLE>' || text) AS completion FROM documents",
}
