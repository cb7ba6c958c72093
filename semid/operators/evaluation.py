"""Scores of generated text against references, probe answers, and dense retrieval against drawn negatives."""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semid.functions.vectors import dot

SCORES = ("exact_match", "edit_ratio", "bleu", "syntax_valid")
# The entities and the splitting rules of the standard BLEU tokenization.
ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SPLITS = (("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " \\1 "), ("([^0-9])([\\.,])", "\\1 \\2 "), ("([\\.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 "))


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, all of a row's cells at once as the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        if at := places.get(c):
            met = row & at
            row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    """1 less the share of characters to insert or delete; 1 for two empty texts."""
    n = len(a) + len(b)
    return 2 * common_length(a, b) / n if n else 1.0


def bleu_tokens(text: str) -> list[str]:
    for old, new in ENTITIES:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, new in SPLITS:
        text = re.sub(pattern, new, text)
    return text.split()


def sentence_bleu(predicted: str, reference: str, order: int = 4) -> float:
    """BLEU of one sentence, from 0 to 1: orders without n-grams are left out, and an order without a match counts half as much as the last such one, from 1/2 on."""
    p, r = bleu_tokens(predicted), bleu_tokens(reference)
    logs, halves, matched = [], 1.0, 0
    for n in range(1, min(order, len(p)) + 1):
        grams = lambda ws, n=n: Counter(zip(*[ws[i:] for i in range(n)], strict=False))
        hits, total = sum((grams(p) & grams(r)).values()), len(p) - n + 1
        matched += hits
        if not hits:
            halves *= 2
        logs.append(math.log(hits / total if hits else 1 / (halves * total)))
    if not matched:
        return 0.0
    return min(1.0, math.exp(1 - len(r) / len(p))) * math.exp(sum(logs) / len(logs))


def parses(code: str, language: str | None) -> bool:
    """Whether Python code parses; code of other languages must only not be blank."""
    if language != "python":
        return bool(code.strip())
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def completion_scores(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Per row of ``rows`` (id, prompt, predicted, reference, language) its id and ``SCORES``, doubles of 0 to 1. Null texts are empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (float(p.strip() == r.strip()), edit_ratio(p, r), sentence_bleu(p, r), float(parses(start + p, language)))
                for start, p, r, language in zip(*(batch.column(c).to_pylist() for c in ("prompt", "predicted", "reference", "language")), strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [()] * len(SCORES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.float64()) for c in columns]], ["id", *SCORES])

    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "predicted", "reference")]
    x = rows.select(F.col(id_col).alias("id"), *texts, "language")
    return x.mapInArrow(run, f"id {dict(x.dtypes)['id']}, " + ", ".join(f"{s} double" for s in SCORES)).withColumnRenamed("id", id_col)


def completion_means(scores: DataFrame) -> DataFrame:
    """One row: the number of samples and the mean of each score, to four places."""
    return scores.agg(F.count("*").alias("num_samples"), *[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias(s) for s in SCORES])


def probe_answers(rows: DataFrame, answer: str = "answer", expected: str = "expected") -> DataFrame:
    """Adds ``correct``: 1 where the expected text, as lower-case and stripped, stands in the answer."""
    plain = lambda c: F.lower(F.btrim(c, F.lit(" \t\n\x0b\f\r")))
    return rows.withColumn("correct", F.coalesce(F.contains(plain(F.col(answer)), plain(F.col(expected))), F.lit(False)).cast("int"))


def dense_evaluation(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, relevant) of each query's positive (j = 0) and drawn negatives by dot product, ties by draw.

    ``candidates`` is (query_id, j, key_id), a stated number of keys for each query;
    ``vectors`` (key_id, vec) and ``queries`` (query_id, vec). Draws without a vector are left out.
    """
    keyed = candidates.join(vectors.select("key_id", F.col("vec").alias("kv")), "key_id").join(queries.select("query_id", F.col("vec").alias("qv")), "query_id")
    scored = keyed.select("query_id", "j", dot(F.col("qv"), F.col("kv")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "j")
    return scored.select("query_id", F.row_number().over(order).alias("rank"), (F.col("j") == 0).cast("int").alias("relevant"))
