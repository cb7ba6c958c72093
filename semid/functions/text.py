"""Text expressions: tokenizers, identifiers, n-grams, hashing vectors, code tokens, chunking, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.functions.vectors import let, unit
from semid.operators.ngrams import LONGEST, frequent_grams
from semid.session import scratch

# Patterns that results depend on.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
CAMEL = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
CHUNK = 4
PIECE = f"[A-Z][a-z]{{1,{CHUNK - 1}}}|[a-z]{{1,{CHUNK}}}|[A-Z]{{1,{CHUNK}}}(?![a-z])|[0-9]{{1,{CHUNK}}}|[^A-Za-z0-9\\s]"
WORD = "(?U)\\S+"
ENDS = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"
SID_TOKEN = "^<SID_L(\\d+)_(\\d+)>$"
SID_IN_TEXT = "<SID_L\\d+_\\d+>|<SID:[\\d-]+>"
STRUCTURAL = ["<SID_START>", "<SID_SEP>", "<SID_END>"]
TASKS = ["<PREDICT_SID>", "<SID_TO_SIG>", "<FIM_PREFIX>", "<FIM_SUFFIX>", "<FIM_MIDDLE>"]
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "sol": "solidity"}
COMMENTS = {"python": "#", "ruby": "#", "go": "//", "rust": "//", "java": "//", "javascript": "//", "typescript": "//", "tsx": "//", "solidity": "//"}


SLUG, COMPACT_SLUG = "[^A-Za-z0-9_-]+", "[^A-Za-z0-9]+"
CODES_OF, SIGNATURE_OF, SIBLINGS, NO_SIBLINGS = "<PREDICT_SID> ", "<SID_TO_SIG>", " methods: ", "(none)"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifiers(text: Column) -> Column:
    return all_matches(text, IDENTIFIER)


def words(text: Column) -> Column:
    """Runs without white space (Unicode white space too)."""
    return all_matches(text, WORD)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def camel_parts(token: Column) -> Column:
    """Parts of a token at case changes; the token itself where there are none."""
    parts = all_matches(token, CAMEL)
    return F.when(F.size(parts) == 0, F.array(token)).otherwise(parts)


def pieces(text: Column) -> Column:
    """The fallback tokenizer: runs of letters and digits, or single other characters; runs are split at case changes and cut into chunks of four.

    One expression finds the chunks themselves: a part that is longer than a chunk goes on as
    a run of its last kind of letters, and upper-case letters leave the last before a lower-case one.
    """
    return all_matches(text, PIECE)


def piece_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE))


def subtokens(token: Column) -> Column:
    return piece_count(token)


def ngrams(items: Column, n: int) -> Column:
    return F.when(F.size(items) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.slice(items, i, n)))


def surface(parts: Column) -> Column:
    """Pieces as plain text: word marks become spaces, white space of all kinds is stripped from the ends."""
    return F.regexp_replace(F.translate(F.array_join(parts, ""), "Ġ▁", "  "), f"^{ENDS}|{ENDS}$", "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")


def hash_vector(text: Column, dim: int = 256) -> Column:
    """Counts of word trigrams (shorter at the end) by md5 modulo ``dim``, a power of two, L2-normalised."""
    digits = max(1, (dim.bit_length() + 2) // 4)

    def run(ws: Column) -> Column:
        places = F.transform(ws, lambda w, i: F.pmod(F.conv(F.right(F.md5(F.array_join(F.slice(ws, i + 1, 3), " ")), F.lit(digits)), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))
        # Sorted with one more place of every dimension, each dimension's run ends once: its count is the run's length less one.
        every = F.sort_array(F.concat(places, F.sequence(F.lit(0), F.lit(dim - 1))))
        ends = let(every, lambda ps: F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: F.coalesce(F.get(ps, i) != F.get(ps, i - 1), F.lit(True))))
        counts = let(ends, lambda es: F.transform(es, lambda e, i: (e - F.coalesce(F.get(es, i - 1), F.lit(0)) - 1).cast("double")))
        return unit(counts, 1e-8)

    return let(words(text), run)


def code_width(size: int) -> int:
    return max(2, len(str(size - 1)))


def sid_token(level: Column | int, code: Column, width: int) -> Column:
    """``<SID_L1_07>``; a code wider than ``width`` is not cut."""
    text = code.cast("string")
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.lit("<SID_L"), level.cast("string"), F.lit("_"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")), F.lit(">"))


def sid_sequence(codes: Column, width: int, structural: bool = True) -> Column:
    """The codes' tokens, inline or between start and end with separators."""
    tokens = F.transform(codes, lambda c, i: sid_token(i + 1, c, width))
    if not structural:
        return F.array_join(tokens, "")
    return F.concat(F.lit(STRUCTURAL[0]), F.array_join(tokens, STRUCTURAL[1]), F.lit(STRUCTURAL[2]))


def parse_sid(token: Column) -> Column:
    """A struct (level, code), levels from 0; null for other tokens."""
    level = F.regexp_extract(token, SID_TOKEN, 1).try_cast("int") - 1
    return F.when(token.rlike(SID_TOKEN), F.struct(level.alias("level"), F.regexp_extract(token, SID_TOKEN, 2).try_cast("int").alias("code")))


def sid_vocabulary(spark, levels: int, size: int) -> DataFrame:
    """(idx, token, level, code, kind): level tokens so that idx = level * size + code, then structural and task tokens."""
    width = code_width(size)
    own = spark.range(levels * size).select(F.col("id").cast("int").alias("idx"), (F.floor(F.col("id") / size)).cast("int").alias("level"), (F.col("id") % size).cast("int").alias("code"))
    own = own.select("idx", sid_token(F.col("level") + 1, F.col("code"), width).alias("token"), "level", "code", F.lit("level").alias("kind"))
    more = [(levels * size + i, t, None, None, "structural" if i < len(STRUCTURAL) else "task") for i, t in enumerate(STRUCTURAL + TASKS)]
    return own.unionByName(spark.createDataFrame(more, "idx int, token string, level int, code int, kind string"))


def special_tokens(text: Column) -> Column:
    return all_matches(text, "<[^>]+>")


def language_of(ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), ext)


def comment_prefix(language: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in COMMENTS.items() for x in p]), language), F.lit("#"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when((F.length(old) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def header_format(body: Column, language: Column, sid: Column) -> Column:
    return F.concat(comment_prefix(language), F.lit(" "), sid, F.lit("\n"), body)


def entity_to_sid(body: Column, sid: Column) -> Column:
    return F.concat(F.lit(CODES_OF), body, F.lit("\n"), sid)


def sid_to_signature(sid: Column, signature: Column) -> Column:
    return F.concat(F.lit(SIGNATURE_OF), sid, F.lit(" "), signature)


def sid_completion(language: Column, parent: Column, siblings: Column, signature: Column, body: Column) -> Column:
    names = F.when(F.size(siblings) > 0, F.array_join(siblings, ", ")).otherwise(NO_SIBLINGS)
    head = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(comment_prefix(language), F.lit(" class "), parent, F.lit(SIBLINGS), names, F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("<FIM_PREFIX>"), signature, F.lit("<FIM_SUFFIX><FIM_MIDDLE>"), body)


def chunk_lines(text: Column, most: int, prefix: Column | None = None, close_at_most: bool = False) -> Column:
    """Greedy chunks of whole lines, each headed by ``prefix``. A chunk closes before a line that would take it over ``most`` characters (a longer line stands alone), or, with ``close_at_most``, once it has reached ``most``."""
    prefix = F.lit("") if prefix is None else prefix
    lines = F.filter(all_matches(text, "[^\\n]*\\n|[^\\n]+$"), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        size = F.length(prefix) + F.length(acc["buf"])
        full = (acc["n"] > 0) & ((size >= most) if close_at_most else (size + F.length(line) > most))
        done = F.when(full, F.concat(acc["done"], F.array(F.concat(prefix, acc["buf"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, line).otherwise(F.concat(acc["buf"], line)).alias("buf"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"))

    return F.aggregate(lines, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.concat(prefix, acc["buf"])))).otherwise(acc["done"]))


def wiki_to_markdown(text: Column) -> Column:
    """Wiki markup as markdown. The rules, in this order, are fixed."""
    rules = [
        ("\\{\\{[^{}]*\\}\\}", ""),
        ("\\[\\[(?:[^|\\]]*\\|)?([^\\]]+)\\]\\]", "$1"),
        ("'''(.+?)'''", "**$1**"),
        ("''(.+?)''", "*$1*"),
        *[(f"(?m)^{'=' * n}\\s*(.+?)\\s*{'=' * n}", f"{'#' * n} $1") for n in range(6, 1, -1)],
        ("(?m)^\\*\\s*", "- "),
        ("(?s)<ref[^>]*>.*?</ref>", ""),
        ("<[^>]+>", ""),
        ("\\n{3,}", "\n\n"),
    ]
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags become spaces, space is collapsed."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))


def slug(title: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(title, SLUG, "_"), F.lit("_")))


def compact_slug(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, COMPACT_SLUG, ""))


def remove_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def drop_extension(path: Column) -> Column:
    return F.regexp_replace(path, "\\.[^./]*$", "")


def has_no_extension(path: Column) -> Column:
    return ~path.rlike("\\.[^./]*$")


def after_segment(path: Column, segment: str, new: str) -> Column:
    """What follows ``segment`` in a path, replaced."""
    at = F.instr(path, segment)
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at + len(segment) - 1), F.lit(new))).otherwise(path)


def between_tags(text: Column, first: str, last: str) -> Column:
    """What stands between two tags; empty without the first."""
    return F.when(F.instr(text, first) > 0, F.substring_index(F.substring(text, F.instr(text, first) + len(first), F.length(text)), last, 1)).otherwise("")


def mine_identifiers(texts: DataFrame, text_col: str = "text", min_frequency: int = 5) -> DataFrame:
    """Candidates (token, frequency, current_subtokens, score, strategy) among identifiers of three letters or more that take several sub-tokens."""
    counts = texts.select(F.explode(identifiers(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    kept = counts.where((F.col("frequency") >= min_frequency) & (F.length("token") >= 3)).withColumn("current_subtokens", subtokens(F.col("token")))
    return kept.where("current_subtokens > 1").withColumns({"score": F.col("frequency") * F.col("current_subtokens"), "strategy": F.lit("identifiers")})


def piece_runs(texts: DataFrame, text_col: str, most: int) -> DataFrame:
    """(_g0, _g1, ...): each piece of a text and the ``most`` - 1 behind it, null behind the text's end."""
    names, size = [f"_g{i}" for i in range(most)], F.size("_p")
    behind = [F.when(size > i, F.slice("_p", F.lit(i + 1), F.greatest(size - i, F.lit(0)))) for i in range(most)]
    zipped = F.arrays_zip(*[F.coalesce(b, F.array().cast("array<string>")).alias(n) for b, n in zip(behind, names, strict=True)])
    return texts.select(pieces(F.col(text_col)).alias("_p")).select(F.explode(zipped).alias("_g")).select("_g.*")


def _long_grams(texts: DataFrame, text_col: str, sizes: tuple[int, ...], least: int) -> DataFrame:
    """(_size, _g0, _g1, ..., frequency) of frequent n-grams of any size: their hashes are counted first, and those of a frequent one, few of all there are, then as strings."""
    spark, names = texts.sparkSession, [f"_g{i}" for i in range(max(sizes))]
    hash_of = lambda n: F.when(F.col(names[n - 1]).isNotNull(), F.xxhash64(*names[:n]))
    rows = piece_runs(texts, text_col, max(sizes))
    hashes = rows.select(F.explode(F.array(*[hash_of(n) for n in sizes])).alias("_h")).where("_h is not null")
    path = scratch(spark, "ngrams")
    hashes.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_h").write.parquet(path)
    sized = rows.select(*names, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), hash_of(n).alias("h")) for n in sizes])).alias("_s")).select(*names, F.col("_s.n").alias("_size"), F.col("_s.h").alias("_h"))
    asked = sized.join(spark.read.schema("_h bigint").parquet(path), "_h", "left_semi")
    return asked.groupBy("_size", *[F.when(F.col("_size") > i, F.col(n)).alias(n) for i, n in enumerate(names)]).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def mine_ngrams(texts: DataFrame, text_col: str = "text", sizes: tuple[int, ...] = (2, 3), min_frequency: int = 25) -> DataFrame:
    """Candidates among n-grams of pieces within a text, that are not identifiers. Of n-grams with one surface the most frequent counts (then the longer).

    N-grams of up to three pieces are counted as numbers, longer ones by their hashes first.
    """
    counts = (frequent_grams if max(sizes) <= LONGEST else _long_grams)(texts, text_col, sizes, min_frequency)
    names = [f"_g{i}" for i in range(max(*sizes, LONGEST))]
    parts = counts.withColumns({"token": surface(F.slice(F.array(*names), F.lit(1), F.col("_size"))), "current_subtokens": F.col("_size")})
    kept = parts.where((F.length("token") >= 3) & ~F.col("token").rlike(f"^{IDENTIFIER}$"))
    best = kept.groupBy("token").agg(F.max(F.struct("frequency", "current_subtokens")).alias("b")).select("token", "b.*")
    return best.withColumns({"score": F.col("frequency") * F.col("current_subtokens"), "strategy": F.lit("ngrams")})


def merge_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of ``first``, and those of ``second`` with other tokens."""
    return first.unionByName(second.join(first.select("token"), "token", "left_anti"))


def reranked(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """Candidates with their score raised by their token's signal, (token, signal); tokens without one have 0."""
    signal = F.coalesce("signal", F.lit(0.0))
    return candidates.join(signals, "token", "left").withColumns({"score": F.col("score") * (1 + signal), "signal": signal, "strategy": F.concat("strategy", F.lit("+gradient"))})


def top_tokens(candidates: DataFrame, n: int) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "token").limit(n)
