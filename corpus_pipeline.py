"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again. All but the last return the
columns of ``documents``.

1. quality: rows that the base rule or the learned decision list rejects go.
2. lines: lines whose key ten or more documents hold go from every text.
3. near duplicates: of each group on five-word shingles the least id stays.
4. secrets: their spans are replaced by ``[secret]``; the documents stay.
5. packing: token windows of 2048, cut and packed by minimum bin slack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semid.llm.common import table, written
from semid.llm.line_dedup import dedup_lines
from semid.llm.near_dedup import near_dedup
from semid.llm.packing import pack
from semid.llm.quality_rules import fit, judge
from semid.llm.secret_scan import redact


def _wrapped(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row as one column, so that no column's name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def _with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The wrapped rows with another text, and its length where the rows have one."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(_wrapped(docs), rules, carry=("_doc",)).where("kept").select("_doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(dedup_lines(_wrapped(docs), least_docs=10, carry=("_doc",)), docs.columns, F.col("kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(_wrapped(redact(docs)), docs.columns, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: The learned list, the similarity search and the tokenizer have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
