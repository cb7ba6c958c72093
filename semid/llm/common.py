"""Shared pieces: tables, the cluster's shared folder, column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of every contract here.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="semid-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body's lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(id_col: str, text: Column) -> Column:
    """Equal for rows that agree in id and text (any results for them agree too)."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), text)))


def running(xs: Column, zero: Column, merge) -> Column:
    """For each element of an array, ``merge`` over all elements before it, starting with ``zero``. Arrays grow in blocks, so long ones are not copied at every step."""
    size = 64

    def scan(ys: Column, begin: Column) -> Column:
        step = lambda acc, y: F.struct(merge(acc["at"], y).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(ys, F.struct(begin.alias("at"), F.slice(F.array(begin), F.lit(1), F.lit(0)).alias("out")), step, lambda acc: acc["out"])

    blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: F.slice(xs, b * size + 1, F.lit(size)))).otherwise(F.slice(F.array(xs), F.lit(1), F.lit(0)))
    of_block = lambda b: F.aggregate(b, zero, merge)
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, of_block), zero), scan)))
