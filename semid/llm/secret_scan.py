"""Secret scans over a trigram inverted index.

From each rule's expression a Boolean trigram query is derived. The index lists,
for every trigram that some query names, the rows whose lower-cased text holds
it. Intersecting a row's postings gives the rules it is a candidate of, and only
candidates are verified with the expressions; rules without a mandatory trigram
scan every text. All steps are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, running, whole
from .trigrams import derive


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
#: The base rules. A run of hexadecimal digits or of key characters is matched whole, so the least lengths can stand in the expressions.
BASE = (
    Rule("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
KEY = "[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
BASE64 = "[A-Za-z0-9+/=]"
#: What follows a BEGIN line without an END line: header lines, then whole lines of base64 of a usual length, then a shorter one.
CUT_OFF = (
    f"(?:\\r?\\n[A-Za-z-]+: [^\\n]*){{0,8}}(?:\\r?\\n)?(?:\\x20?{BASE64}{{16,}})?"
    + "(?:" + "|".join(f"(?:{end}{BASE64}{{{n}}})+" for n in (76, 70, 64) for end in ("\\n", "\\r\\n")) + ")?"
    + f"(?:\\r?\\n{BASE64}{{16,}})?"
)
MORE = (
    # To the next END line, whatever stands between, else over the lines that can be the key's.
    Rule("pem", f"-----BEGIN {KEY}(?:[\\s\\S]*?-----END {KEY}|{CUT_OFF})"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,kind:int,end:int>>"
WORD = 62  # trigrams in each mask


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for query in derive(r.pattern) for clause in query for t in clause})


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each trigram of ``grams`` and row of ``rows`` (key, text) whose lower-cased text holds it."""
    low = rows.select("key", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda g: g.isNotNull())
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(key, rules): the bit set of the rules whose query a row's postings satisfy; rows with none are left out."""
    at = {g: i for i, g in enumerate(grams)}
    masks = range((len(grams) + WORD - 1) // WORD)
    own = [F.bit_or(F.when(F.floor(F.col("gram") / WORD) == m, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % WORD)).otherwise(F.lit(0).cast("long"))).alias(f"m{m}") for m in masks]

    def holds(clause: frozenset[str]) -> Column:
        bits = [sum(1 << (at[g] % WORD) for g in clause if at[g] // WORD == m) for m in masks]
        return reduce(lambda a, b: a & b, [F.col(f"m{m}").bitwiseAND(F.lit(b).cast("long")) == b for m, b in enumerate(bits) if b])

    found = F.lit(0)
    for i, r in enumerate(rules):
        if query := derive(r.pattern):
            every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(holds, clauses)) for clauses in query])
            found = found + F.when(every, 1 << i).otherwise(0)
    return index.groupBy("key").agg(*own).select("key", found.alias("rules")).where("rules <> 0")


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of ``rule`` in code points: lengths of the pieces between matches and of the matches, summed up in order."""
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"))
    sizes = F.transform(found, lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))

    def spans(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x["p"] + F.coalesce(x["m"], F.lit(0))), F.lit(0), lambda acc, n: acc + n)
        all_spans = F.zip_with(xs, before, lambda x, at: F.struct((at + x["p"]).alias("start"), F.lit(kind).alias("kind"), (at + x["p"] + x["m"]).alias("end"), x["g"].alias("size")))
        return F.transform(F.filter(all_spans, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(sizes, spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: its id, the ``carry`` columns and ``spans``, an array of (start, kind, end) by start, then kind.

    Starts and ends count code points, ends exclusive; kind is the rule's place in
    ``rules``. Null texts are empty and have no spans; repeated rows each give a row;
    an empty table gives none. Columns that are not named are ignored.
    """
    grams, names = vocabulary(rules), list(dict.fromkeys((id_col, *carry)))
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("named"), F.col(id_col).alias("id"), whole(text_col).alias("text")).select("named", "text", row_key("id", F.col("text")).alias("key"))
    found = candidates(postings(rows.select("key", "text"), grams), rules, grams)
    joined = rows.join(found, "key", "left")
    text, spans = F.col("text"), []
    for i, r in enumerate(rules):
        asked = F.col("rules").bitwiseAND(F.lit(1 << i)) != 0 if derive(r.pattern) else F.lit(True)
        spans.append(F.when(asked & text.rlike(r.pattern), rule_spans(text, r, i)).otherwise(F.array().cast(SPANS)))
    done = joined.select("named", F.sort_array(F.concat(*spans)).alias("spans"))
    return done.select(*[F.col("named")[c].alias(c) for c in names], "spans")


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans and all spans, as text, for each row of ``docs``."""
    found = secret_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def cut_out(text: Column, spans: Column, instead: str, block: int = 128) -> Column:
    """``text`` with its spans (by start) replaced, overlapping ones together. It is cut into a stretch for each ``block`` of spans and those at the spans, so that neither many spans nor a long text is read again for each span."""
    covered = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda acc, end: F.greatest(acc, end))
    placed = F.zip_with(spans, covered, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))

    def stretches(zs: Column) -> Column:
        def one(b: Column) -> Column:
            part = F.slice(zs, b * block + 1, F.lit(block))
            low = F.get(zs, b * block)["at"]
            high = F.coalesce(F.get(zs, (b + 1) * block)["at"], F.length(text))
            last = F.array_max(F.transform(part, lambda z: F.greatest(z["end"], z["at"])))

            def pieces(chunk: Column) -> Column:
                kept = F.transform(part, lambda z: F.when(z["start"] >= z["at"], F.concat(F.substring(chunk, z["at"] - low + 1, z["start"] - z["at"]), F.lit(instead))).otherwise(""))
                return F.concat(F.array_join(kept, ""), F.substring(chunk, last - low + 1, high - last))

            return let(F.substring(text, low + 1, high - low), pieces)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(zs) - 1) / block).cast("int")), one), "")

    return let(placed, stretches)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret's span replaced by ``[secret]``; overlapping spans are replaced together. Texts without secrets, null ones too, stay as they are."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col("_doc")[text_col]
    clean = F.when(F.size("spans") > 0, cut_out(text, F.col("spans"), "[secret]")).otherwise(text)
    done = secret_spans(rows, id_col, text_col, carry=("_doc",)).select("_doc", clean.alias("_clean"))
    return done.select(*[F.col("_clean").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
