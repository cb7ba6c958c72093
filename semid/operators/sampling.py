"""Deterministic sampling and splitting. Every random choice is a rank or remainder of md5(key|seed), so any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semid.functions.vectors import let
from semid.session import scratch


def hash_key(key: str | Column, seed: int | str = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hash_number(h: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits as a number."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def shuffled(df: DataFrame, key: str, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Rows in hash order; the first ``limit`` of them."""
    out = df.orderBy(hash_key(key, seed), key)
    return out.limit(limit) if limit is not None else out


def placed(rows: DataFrame, order: list, name: str, most: int = 2_000_000) -> DataFrame:
    """``rows`` with their places from 1 in ``order``, a list of columns.

    The order is cut into ranges of about ``most`` rows, each sorted and numbered by one
    task, behind all rows of the ranges before it. Numbered rows are a table in the shared
    folder, so that a repeated task can't number them anew. Only rows equal in all of
    ``order`` can't be divided.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "placed")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // most)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    numbered = spark.read.schema(dealt.schema).parquet(path).withColumns({"_range": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = numbered.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    joined = numbered.join(F.broadcast(begins), "_range")  # a row for each range
    return joined.withColumn(name, F.col("_begin") + F.col("_at") + 1).drop("_range", "_at", "_begin")


def ranked(df: DataFrame, group: str, order: list, name: str, large: int = 1_000_000) -> DataFrame:
    """Adds ``name``, the rank from 1 of each row in its group by ``order``, and ``name``_n, the group's size.

    Groups are counted first. Where none has more than ``large`` rows a window does it all;
    the rows of larger ones are placed in ranges of group and order, and their ranks are
    their places behind their group's first. A null group is one too.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    plain = lambda x: x.withColumns({name: F.row_number().over(own.orderBy(*order)).cast("bigint"), f"{name}_n": F.count("*").over(own)})
    hot = sizes.where(F.col("_n") > large).select("_group")
    if hot.isEmpty():
        return plain(df)
    hot, same = F.broadcast(hot), F.col(group).eqNullSafe(F.col("_group"))  # a row for each ``large`` rows at most
    numbered = placed(df.join(hot, same, "left_semi"), [group, *order], "_place")
    firsts = numbered.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count("*").alias(f"{name}_n"))
    wide = numbered.join(F.broadcast(firsts), same).withColumn(name, F.col("_place") - F.col("_first") + 1)
    small = plain(df.join(hot, same, "left_anti"))
    return small.unionByName(wide.select(small.columns))


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: in each stratum the first max(1, floor(n * fraction)) rows in hash order are 'eval' (none of a single row), the rest 'train'."""
    h = hash_key(key, seed)
    out = ranked(df, stratum, [h, key], "_rank")
    first = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_rank_n") * fraction))
    return out.withColumn("split", F.when((F.col("_rank_n") > 1) & first, "eval").otherwise("train")).drop("_rank", "_rank_n")


def resample(df: DataFrame, group: str, key: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Draws with replacement: ``targets`` (group, target) rows of each group, every draw a slot whose hash names a row's rank in its group by the numeric ``key``."""
    rows = ranked(df, group, [key], "_rank").withColumn("_rank", F.col("_rank") - 1).drop("_rank_n")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    slots = targets.join(sizes, group).where("target > 0").select(group, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("target").cast("long") - 1)).alias("slot"))
    drawn = slots.withColumn("_rank", F.pmod(hash_number(F.md5(F.concat_ws("|", F.col(group).cast("string"), F.col("slot").cast("string"), F.lit(str(seed))))), F.col("_n")))
    return drawn.drop("_n").join(rows, [group, "_rank"]).drop("_rank")


def weighted_targets(df: DataFrame, group: str, weights: dict[str, float]) -> DataFrame:
    """target = int(all rows * weight) for each group; groups without a weight get none."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    return sizes.crossJoin(F.broadcast(total)).select(group, F.floor(F.col("total") * F.coalesce(F.try_element_at(known, F.col(group)), F.lit(0.0))).alias("target"))


def mix_targets(df: DataFrame, group: str, weights: dict[str, float]) -> DataFrame:
    """target = int(largest group * weight / sum of weights * number of groups)."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("w", F.coalesce(F.try_element_at(known, F.col(group)), F.lit(0.0)))
    of_all = sizes.agg(F.max("n").alias("most"), F.sum("w").alias("sum"), F.count("*").alias("groups"))  # one row
    return sizes.crossJoin(F.broadcast(of_all)).select(group, F.floor(F.col("most") * F.col("w") / F.col("sum") * F.col("groups")).alias("target"))


def interleave_count(others: Column, fraction: float) -> Column:
    """How many rows to add to ``others`` so that they are ``fraction`` of the whole."""
    return F.floor(others * fraction / max(1e-6, 1 - fraction))


def interleaved(main: DataFrame, others: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of ``main`` and as many of ``others`` as make ``fraction`` of the whole, with their ``place`` in one shuffled order.

    ``others`` are drawn without replacement, the first in hash order, while there are
    enough, else with replacement: each draw a slot whose hash names a row. Both tables
    have the same columns; ``slot`` tells repeated draws apart and is 0 elsewhere.
    """
    columns, n_main, n_others = main.columns, main.count(), others.count()
    wanted = int(n_main * fraction / max(1e-6, 1 - fraction)) if n_others else 0
    order = placed(others.withColumn("_h", hash_key(key, seed)), ["_h", key], "_row")
    if wanted <= n_others:
        drawn = order.where(F.col("_row") <= wanted).select(*columns, F.lit(0).cast("bigint").alias("slot"))
    else:
        slots = others.sparkSession.range(wanted).select(F.col("id").alias("slot"), (F.pmod(hash_number(F.md5(F.concat_ws("|", F.lit("slot"), F.col("id").cast("string"), F.lit(str(seed))))), F.lit(n_others)) + 1).alias("_row"))
        drawn = slots.join(order, "_row").select(*columns, "slot")
    both = main.select(*columns, F.lit(0).cast("bigint").alias("slot"), F.lit(0).alias("_from")).unionByName(drawn.withColumn("_from", F.lit(1)))
    mixed = both.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("slot").cast("string"), F.col("_from").cast("string"), F.lit(str(seed)))))
    return placed(mixed, ["_h", "_from", key, "slot"], "place").drop("_h", "_from")


def ratio_bucket(key: str | Column, ratios: dict[str, float], default: str, seed: int | str = "") -> Column:
    """The first name whose cumulative ratio exceeds the key's hash in [0, 1), by thousandths."""
    share, out, upto = F.pmod(hash_number(hash_key(key, seed)), F.lit(1000)), None, 0.0
    for name, ratio in ratios.items():
        upto += ratio
        hit = share < round(upto * 1000)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def fill_in_middle(text: Column, key: Column, seed: int = 42, least: int = 16) -> Column:
    """Prefix, suffix, middle at two different sorted cuts; texts shorter than ``least`` stay."""
    n = F.length(text)
    a = F.pmod(hash_number(hash_key(key, f"{seed}a")), n)
    b = F.pmod(a + 1 + F.pmod(hash_number(hash_key(key, f"{seed}b")), n - 1), n)
    lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    cut = F.concat(F.lit("<FIM_PREFIX>"), F.substring(text, F.lit(1), lo), F.lit("<FIM_SUFFIX>"), F.substring(text, hi + 1, n), F.lit("<FIM_MIDDLE>"), F.substring(text, lo + 1, hi - lo))
    return F.when(n < least, text).otherwise(cut)


def masked_places(n: Column, key: Column, seed: int = 42, lowest: float = 0.3, highest: float = 0.7) -> Column:
    """The places, of ``n``, to mask: a share between the bounds, drawn by hash, of the places in hash order."""
    # In whole millionths, so that the rounding is the same everywhere.
    rate = round(lowest * 1_000_000) + round((highest - lowest) * 1000) * F.pmod(hash_number(hash_key(key, f"{seed}r")), F.lit(1000))

    def run(size: Column) -> Column:
        ordered = F.array_sort(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("i"))))
        return F.array_sort(F.transform(F.slice(ordered, F.lit(1), F.floor(size * rate / 1_000_000).cast("int")), lambda x: x["i"]))

    return F.when(n > 0, let(n, run)).otherwise(F.array().cast("array<int>"))


def top_half(df: DataFrame, score: str, key: str) -> DataFrame:
    """The better half of the rows by ``score``, at least one; ties by ``key``."""
    out = ranked(df.withColumn("_all", F.lit(0)), "_all", [F.desc(score), key], "_rank")
    return out.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_rank_n") / 2))).drop("_all", "_rank", "_rank_n")


def assign_files(sizes: list[tuple[str, int]], workers: int, how: str = "greedy") -> list[list[str]]:
    """Files to workers: greedily to the least loaded by size, in turn, or all to all. Spark's own scans pack files by themselves; this serves other consumers of a listing."""
    if how == "all":
        return [[p for p, _ in sizes] for _ in range(workers)]
    out, load = [[] for _ in range(workers)], [0] * workers
    for i, (path, size) in enumerate(sizes if how == "turn" else sorted(sizes, key=lambda x: (-x[1], x[0]))):
        w = i % workers if how == "turn" else min(range(workers), key=lambda k: (load[k], k))
        out[w].append(path)
        load[w] += size
    return out


def sampled_subsequences(seq: Column, key: Column, n: int, seed: int = 42) -> Column:
    """Parts of two or more neighbouring items: all of them where there are at most ``n``, else ``n`` draws, which may repeat. A part's number counts parts by their end, then their start."""
    total = (F.size(seq) * (F.size(seq) - 1) / 2).cast("bigint")
    draw = lambda j: F.pmod(hash_number(F.md5(F.concat_ws("|", key.cast("string"), j.cast("string"), F.lit(str(seed))))), total)

    def part(i: Column) -> Column:
        end = F.floor((1 + F.sqrt(1 + 8 * i.cast("double"))) / 2).cast("int")
        return let(end, lambda e: let((i - (e.cast("bigint") * (e - 1) / 2).cast("bigint")).cast("int"), lambda start: F.slice(seq, start + 1, e - start + 1)))

    numbers = F.when(total <= n, F.sequence(F.lit(0).cast("bigint"), total - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw))
    return F.when(total > 0, F.transform(numbers, part)).otherwise(F.slice(F.array(seq), F.lit(1), F.lit(0)))
