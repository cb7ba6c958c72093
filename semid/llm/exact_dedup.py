"""Exact deduplication without skewed keys.

Copies are combined in three steps, and every step groups by the whole text
beside its digest, so content and not only digests is compared:

1. locally: the partial aggregate of each task keeps one row for each text;
2. by (digest, salt, text): a digest of very many rows meets in ``salts`` tasks;
3. by (digest, text): at most ``salts`` winners of a text meet.

Rows find their group by digest alone when step 3 found a single text under the
digest (then all its rows hold that text). A digest with several texts, which a
cryptographic hash never shows, is matched by digest and text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Of equal texts the largest id stays. Null texts count as empty; a null id never
    beats another and its row is not kept unless all ids of its group are null;
    rows that repeat the winner's id are all marked as kept and counted in
    ``group_size``. Other columns of ``docs`` are ignored, whatever their names.
    ``digest`` maps the text column to a short binary column.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("digest", digest(F.col("text"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    salted = base.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    known = written(winners.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "digests")
    by_salt = base.groupBy("digest", "salt").agg(F.count("*").alias("_n"))
    one = by_salt.join(known.where("texts = 1"), "digest").select("digest", "salt", "keep_id", "group_size")
    out = base.select("id", "digest", "salt").join(one, ["digest", "salt"]).select("id", "keep_id", "group_size", "digest")
    several = known.where("texts > 1").select("digest")
    if not several.isEmpty():  # digests shared by different texts: never under SHA-256
        rest = base.select("id", "digest", "text").join(several, "digest", "left_semi").join(winners, ["digest", "text"])
        out = out.unionByName(rest.select("id", "keep_id", "group_size", "digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest id (of rows with equal text and id, one)."""
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("keep_id"), F.col("digest").alias("keep_digest")).distinct()
    named = docs.select(F.col(id_col).alias("id"), sha256(whole(text_col)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = named.join(kept, (F.col("digest") == F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
