"""Batches for training as rows: sequences of near length together, padded, with masks and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.operators.sampling import hash_key, placed
from semid.operators.sequences import next_k_labels, remove_token, tail

#: Label functions by name: of a sequence and options they give a struct (input, labels).
LABELS: dict[str, Callable[..., Column]] = {
    "next_k": lambda seq, k=1, mask_token=1, pad=0: next_k_labels(seq, k, mask_token, pad),
    "identity": lambda seq: F.struct(seq.alias("input"), seq.alias("labels")),
    "shifted": lambda seq: F.struct(F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0))).alias("input"), F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0))).alias("labels")),
}


def _filled(rows: Column, width: Column, pad) -> Column:
    """Every array of ``rows`` brought to ``width`` on the right."""
    return F.transform(rows, lambda x: F.concat(x, F.array_repeat(F.lit(pad).cast("bigint"), width - F.size(x))))


def collated(rows: DataFrame, key: str, fields: list[str], batch_rows: int, length: int, pad: int = 0, oov: int | None = None, labels: dict[str, tuple[str, dict]] | None = None, seed: int = 42) -> DataFrame:
    """A row for each batch of up to ``batch_rows`` rows: batch_id, width, keys, each of ``fields`` as equally long arrays, mask, and ``<field>_labels`` for the fields in ``labels``.

    Sequences lose the ``oov`` token and keep their last ``length`` items; ``labels`` names
    a function of ``LABELS`` and its options for a field, whose inputs replace its sequences.
    Rows stand in the order of their longest field, then of a hash of their key: the
    place of all of them, worked out in ranges, says which batch they are in. So a batch is
    padded to ``width``, its own longest sequence, and all batches together hold fewer than
    ``length`` * ``batch_rows`` padded places a field whose lengths agree. ``mask`` is 1 where the first field has an
    item, also one equal to ``pad``. Null sequences are empty ones; no rows give no batches.
    """
    labels = labels or {}
    named = [F.coalesce(tail(remove_token(F.col(f).cast("array<bigint>"), oov), length), F.array().cast("array<bigint>")).alias(f) for f in fields]
    out = rows.select(F.col(key).alias("_key"), *named)
    for f, (name, options) in labels.items():
        out = out.withColumn("_made", LABELS[name](F.col(f), **options)).withColumns({f: F.col("_made.input"), f"{f}_labels": F.col("_made.labels")}).drop("_made")
    out = out.withColumn("_n", F.greatest(*[F.size(f) for f in fields], F.lit(0)))
    order = placed(out.withColumn("_h", hash_key(F.col("_key"), seed)), ["_n", "_h", "_key"], "_place").withColumn("batch_id", F.floor((F.col("_place") - 1) / batch_rows))
    made = [f"{f}_labels" for f in labels]
    whole = order.groupBy("batch_id").agg(F.max("_n").alias("width"), F.sort_array(F.collect_list(F.struct("_place", "_key", *fields, *made))).alias("_rows"))  # batch_rows at most
    each = lambda c: F.transform("_rows", lambda r: r[c])
    mask = F.transform(each(fields[0]), lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), F.col("width") - F.size(x))))
    return whole.select("batch_id", "width", each("_key").alias("keys"), *[_filled(each(f), F.col("width"), pad).alias(f) for f in fields], mask.alias("mask"), *[each(m).alias(m) for m in made])


def stacked(rows: DataFrame, key: str, features: dict[str, str], batch_rows: int, seed: int = 42) -> DataFrame:
    """A row for each batch of items: batch_id, keys, and every feature (column to its name) as an array over the batch, in the hash order of the keys."""
    out = placed(rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(features)], hash_key(F.col(key), seed).alias("_h")), ["_h", "_key"], "_place")
    whole = out.groupBy(F.floor((F.col("_place") - 1) / batch_rows).alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("_place", "_key", *[f"_f{i}" for i in range(len(features))]))).alias("_rows"))
    each = lambda c: F.transform("_rows", lambda r: r[c])
    return whole.select("batch_id", each("_key").alias("keys"), *[each(f"_f{i}").alias(name) for i, name in enumerate(features.values())])


def batch_lines(batches: DataFrame, fields: list[str]) -> DataFrame:
    """(batch_id, slot, key, width, each of ``fields``): a row for each place of a batch."""
    lines = batches.select("batch_id", "width", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), *[F.col(f) for f in fields])).alias("slot", "r"))
    return lines.select("batch_id", "slot", F.col("r.key").alias("key"), "width", *[F.col(f"r.{f}").alias(f) for f in fields])
