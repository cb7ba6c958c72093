"""Quality rules: decision lists learned by sequential covering.

Statistics of a bounded sample of labelled texts are gathered with DataFrame
functions; sequential covering on the driver grows conjunctions of thresholds by
information gain, prunes each on held-out rows, and keeps those that are precise
there. The list becomes one ordered ``CASE WHEN`` expression over the statistics.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, let, whole, written

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Names of the learned conditions' statistics, each from 0 up and the same for long and short texts.
FEATURES = ("mean_word", "symbol_ratio", "bang_ratio", "bar_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "same_next_ratio", "word_limit")


def text_words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{BLANK_RE}+", -1))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more.

    Windows are hashed first; only a text whose hashes are not all different has its
    windows sorted and compared as whole strings.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        strings = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["s"] == F.get(s, k)["s"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(strings, places), total)

    twice = let(windows(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).when(twice, covered(words)).otherwise(F.lit(0).cast("long"))


def _stats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("same_next"),
        )

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return F.struct(let(text_words(text), of_words).alias("w"), of_lines.alias("l"), count(SYMBOLS).alias("symbols"), count("!").alias("bangs"), count("[|]").alias("bars"), count("[A-Z]").alias("uppers"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row its id, the ``carry`` columns, the base counts and ``FEATURES``. Null texts have no words; ratios of nothing are 0."""
    named = [F.col(c) for c in dict.fromkeys((id_col, *carry))]
    x = docs.select(*named, _stats(whole(text_col)).alias("_s")).select(
        *named, F.col("_s.w.n_words"), F.col("_s.w.word_chars"), F.col("_s.symbols").alias("n_symbols"), F.col("_s.l.dup").alias("n_dup_lines"), F.col("_s.w.n_repeat_words"),
        F.col("_s.l.lines").alias("_lines"), F.col("_s.w.same_next").alias("_same"), F.col("_s.bangs").alias("_bangs"), F.col("_s.bars").alias("_bars"), F.col("_s.uppers").alias("_uppers"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return x.select(
        *named, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word"), ratio("n_symbols", "word_chars").alias("symbol_ratio"), ratio("_bangs", "n_words").alias("bang_ratio"), ratio("_bars", "n_words").alias("bar_ratio"), ratio("_uppers", "word_chars").alias("upper_ratio"),
        ratio("n_dup_lines", "_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"), ratio("_same", "n_words").alias("same_next_ratio"), F.least(F.col("n_words"), F.lit(100)).cast("double").alias("word_limit"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions, each rejecting; what none of them takes is kept."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def keeps(self) -> Column:
        out = None
        for conditions in self.rules:
            every = reduce(lambda a, b: a & b, [c.column() for c in conditions])
            out = F.when(every, F.lit(False)) if out is None else out.when(every, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rejects(self, row: dict) -> bool:
        return any(all(c.holds(row) for c in rule) for rule in self.rules)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: list[dict]) -> Condition | None:
    """The threshold condition of the highest information gain on ``rows``, found in one sweep of each statistic."""
    p0 = sum(r["bad"] for r in rows)
    n0 = len(rows) - p0
    best, top = None, 1e-9
    for f in FEATURES:
        ordered = sorted(rows, key=lambda r: r[f])
        p = n = 0
        for a, b in zip(ordered, ordered[1:], strict=False):
            p, n = p + a["bad"], n + 1 - a["bad"]
            if a[f] < b[f]:
                middle = (a[f] + b[f]) / 2
                for above, g in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                    if g > top:
                        best, top = Condition(f, above, middle), g
    return best


def learn(rows: list[dict], least_precision: float = 0.95, least_support: int = 2, most_rules: int = 16, most_conditions: int = 4) -> DecisionList:
    """Sequential covering over rows that hold ``FEATURES``, ``bad`` (0 or 1) and ``held`` (true: used for pruning only)."""
    grow, prune, rules = [r for r in rows if not r["held"]], [r for r in rows if r["held"]], []
    while len(rules) < most_rules and any(r["bad"] for r in grow):
        left, conditions = grow, []
        while len(conditions) < most_conditions and not all(r["bad"] for r in left) and (c := _best(left)):
            conditions.append(c)
            left = [r for r in left if c.holds(r)]
        if not conditions:
            break

        def worth(k: int, whole=tuple(conditions)) -> tuple[float, int]:
            taken = [r for r in prune if all(c.holds(r) for c in whole[:k])]
            p = sum(r["bad"] for r in taken)
            return ((2 * p - len(taken)) / len(taken) if taken else -1.0, -k)

        rule = tuple(conditions[: max(range(1, len(conditions) + 1), key=worth)])
        taken = [r for r in rows if all(c.holds(r) for c in rule)]
        held = [r for r in taken if r["held"]]
        precise = all(sum(r["bad"] for r in x) >= least_precision * len(x) for x in (taken, held))
        rest = [r for r in grow if not all(c.holds(r) for c in rule)]
        if len(taken) < least_support or not precise or len(rest) == len(grow):
            break
        rules.append(rule)
        grow, prune, rows = rest, [r for r in prune if not all(c.holds(r) for c in rule)], [r for r in rows if not all(c.holds(r) for c in rule)]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> DecisionList:
    """Learns from at most ``most_rows`` labelled rows (those of the lowest id hashes), a bounded sample that the driver gathers; a third of them are held out for pruning. Labels other than 0 and 1, and null ids, are left out. Rows the base rule fails are not learned from."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    stats = statistics(rows, "_id", "_text", carry=("_label",)).where(~base_failed())
    one = stats.groupBy("_id").agg(F.min(F.struct("_label", *FEATURES)).alias("_s")).select("_id", "_s.*")  # of rows that repeat an id one is learned from
    got = [r.asDict() for r in written(one, "labelled").collect()]
    got.sort(key=lambda r: (str(r["_id"]), *[r[f] for f in FEATURES]))
    return learn([r | {"bad": 1 - r["_label"], "held": hashlib.md5(str(r["_id"]).encode()).digest()[0] % 3 == 0} for r in got])


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of every row with ``base_failed`` and ``kept``: false where the base rule fails, else the list's verdict. Null and empty texts have fewer than ten words and fail."""
    return statistics(docs, id_col, text_col, carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())
