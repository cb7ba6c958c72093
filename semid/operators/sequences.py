"""User histories: building, mapping to codes, trimming, padding, labels, sub-sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semid.functions.vectors import let


def user_sequences(events: DataFrame, user_col: str, item_col: str, order_cols: list[str], out: str = "seq") -> DataFrame:
    """(user, seq): each user's items in order."""
    return events.groupBy(user_col).agg(F.array_sort(F.collect_list(F.struct(*order_cols, F.col(item_col).alias("_item")))).alias("_s")).select(user_col, F.transform("_s", lambda x: x["_item"]).alias(out))


def tail(seq: Column, n: int) -> Column:
    return F.slice(seq, F.greatest(F.size(seq) - n + 1, F.lit(1)), n)


def head(seq: Column, n: int) -> Column:
    return F.slice(seq, 1, n)


def pad_or_trim(seq: Column, n: int, pad: int = 0) -> Column:
    """The last ``n`` items, padded on the right."""
    return let(tail(seq, n), lambda t: F.concat(t, F.array_repeat(F.lit(pad).cast("bigint"), n - F.size(t))))


def attention_mask(seq: Column, pad: int = 0) -> Column:
    return F.transform(seq, lambda x: (x != pad).cast("int"))


def remove_token(seq: Column, token: int | None) -> Column:
    """Without the out-of-vocabulary token; unlike a truth test this also removes token 0."""
    return seq if token is None else F.filter(seq, lambda x: x != token)


def longer_than(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows in which every listed sequence has at least ``least`` items."""
    for c in columns:
        df = df.where(F.size(c) >= least)
    return df


def next_k_labels(seq: Column, k: int, mask_token: int, pad: int = 0) -> Column:
    """A struct (input, labels): the last ``k`` items are labels; in the input the first of them is the mask token and the others padding. Shorter sequences than k + 1 are an error."""
    body = F.concat(F.slice(seq, 1, F.size(seq) - k), F.array(F.lit(mask_token).cast("bigint")), F.array_repeat(F.lit(pad).cast("bigint"), k - 1))
    ok = F.when(F.size(seq) > k, F.struct(body.alias("input"), F.slice(seq, -k, k).alias("labels")))
    return F.when(F.size(seq) > k, ok).otherwise(F.raise_error(F.lit("sequence too short for its labels")))


def identity_labels(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, col, label): every place's own item."""
    return df.select(key, F.posexplode(seq).alias("col", "label"))


def gather(df: DataFrame, places: DataFrame, key: str, seq: str, col: str = "col") -> DataFrame:
    """The items of ``seq`` at the places (key, col)."""
    return places.join(df.select(key, seq), key).select(key, col, F.get(seq, F.col(col)).alias("value"))


def contiguous_subsequences(df: DataFrame, seq: str, least: int = 2, longest: int | None = None) -> DataFrame:
    """Adds (start, length, sub) for every contiguous part of at least ``least`` items: k(k-1)/2 rows for k items, for ``least`` of 2. ``longest`` bounds a part's length by dropping its oldest items, not rows."""
    n = F.size(seq)
    starts = df.where(n >= least).withColumn("start", F.explode(F.sequence(F.lit(1), n - (least - 1))))
    both = starts.withColumn("length", F.explode(F.sequence(F.lit(least), n - F.col("start") + 1)))
    sub = F.slice(seq, F.col("start"), F.col("length"))
    return both.withColumn("sub", tail(sub, longest) if longest else sub)


def map_to_codes(df: DataFrame, sid_map: DataFrame, key: str, seq: str, levels: int | None = None, out: str = "codes") -> DataFrame:
    """Items as their codes, flattened in order; an item without codes is an error. ``sid_map`` is (item_id, codes)."""
    items = df.select(key, F.posexplode(seq).alias("pos", "item_id"))
    joined = items.join(sid_map.select("item_id", "codes"), "item_id", "left")
    codes = F.coalesce(F.col("codes"), F.raise_error(F.concat(F.lit("no codes for item "), F.col("item_id").cast("string"))).cast("array<int>"))
    codes = F.slice(codes, 1, levels) if levels else codes
    return joined.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", codes.alias("codes")))), lambda x: x["codes"])).alias(out))


def map_to_embeddings(df: DataFrame, embeddings: DataFrame, item_col: str, id_col: str, vec_col: str, missing: str = "error") -> DataFrame:
    """Adds each row's item's vector; rows of items without one are an error, or left out with ``missing="drop"``, or kept with none with ``"null"``."""
    found = df.join(embeddings.select(F.col(id_col).alias(item_col), vec_col), item_col, "inner" if missing == "drop" else "left")
    if missing != "error":
        return found
    none = F.raise_error(F.concat(F.lit("no vector for item "), F.coalesce(F.col(item_col).cast("string"), F.lit("null")))).cast(dict(embeddings.dtypes)[vec_col])
    return found.withColumn(vec_col, F.coalesce(F.col(vec_col), none))


def category_index(df: DataFrame, mapping: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """``mapping`` is (value, idx); unknown values become 0."""
    return df.join(mapping.select(F.col("value").alias(col), F.col("idx").alias(out)), col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def category_index_list(seq: Column, mapping: dict[str, int]) -> Column:
    """As :func:`category_index` for a list and a fixed mapping."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(seq, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(0)))


def level_offsets(seq: Column, levels: int, size: int, mask: Column | None = None) -> Column:
    """Adds level * size to the digits, cyclically; masked places become 0."""
    moved = F.transform(seq, lambda x, i: x + (i % levels) * size)
    return moved if mask is None else F.zip_with(moved, mask, lambda x, m: x * m)


def with_separators(seq: Column, levels: int, separator: int) -> Column:
    """A separator after every ``levels`` digits."""
    groups = F.sequence(F.lit(0), F.floor((F.size(seq) - 1) / levels).cast("int"))
    return F.when(F.size(seq) == 0, seq).otherwise(F.flatten(F.transform(groups, lambda g: F.concat(F.slice(seq, g * levels + 1, levels), F.array(F.lit(separator).cast("bigint"))))))


def mask_with_separators(mask: Column, levels: int) -> Column:
    """The mask for :func:`with_separators`: a separator has the mask of its group's last digit."""
    groups = F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / levels).cast("int"))
    return F.when(F.size(mask) == 0, mask).otherwise(F.flatten(F.transform(groups, lambda g: let(F.slice(mask, g * levels + 1, levels), lambda p: F.concat(p, F.slice(p, -1, 1))))))


def user_bin(user: Column, bins: int) -> Column:
    return F.pmod(user, F.lit(bins))


def last_k_mask(length: Column, k: int, width: int) -> Column:
    """1 at the last ``k`` of ``length`` places of ``width``, clamped at the start."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ((i < length) & (i >= length - k)).cast("int"))


def pooled(rows: DataFrame, key: str, pos: str, vec: str, width: int, how: str | Callable[[Column], Column] = "mean", last_k: int | None = None) -> DataFrame:
    """One vector a key from its vectors by position: their mean (of the last ``last_k``), the first or the last; or, by a function of a column that aggregates, its result for each dimension."""
    if callable(how):
        return rows.groupBy(key).agg(F.array(*[how(F.get(vec, F.lit(i))) for i in range(width)]).alias("pooled"))
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return rows.groupBy(key).agg(pick(vec, pos).alias("pooled"))
    if last_k:
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).where(F.col("_rank") <= last_k)
    return rows.groupBy(key).agg(F.array(*[F.sum(F.get(vec, F.lit(i))) / F.greatest(F.count("*"), F.lit(1)) for i in range(width)]).alias("pooled"))


def subtoken_means(tokens: DataFrame, old: DataFrame, width: int, decay: float | None = None) -> DataFrame:
    """New tokens' vectors from those of their sub-tokens: the mean, or with weights decay**j; without sub-tokens the global mean. ``tokens`` is (token, ids), ``old`` (id, vec)."""
    parts = tokens.select("token", F.posexplode("ids").alias("j", "id")).join(old.select("id", "vec"), "id")
    weight = F.lit(1.0) if decay is None else F.pow(F.lit(decay), F.col("j"))
    own = parts.withColumn("w", weight).groupBy("token").agg(F.array(*[F.sum(F.get("vec", F.lit(i)) * F.col("w")) / F.sum("w") for i in range(width)]).alias("vec"))
    mean = old.agg(F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(width)]).alias("_mean"))  # one row
    return tokens.select("token").join(own, "token", "left").crossJoin(F.broadcast(mean)).select("token", F.coalesce("vec", "_mean").alias("vec"))
