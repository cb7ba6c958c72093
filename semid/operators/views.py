"""The views of an entity (its texts by kind), their vectors, and predicted codes against its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.functions.renderings import definition_blob
from semid.functions.text import slug
from semid.operators.encoding import Encoder, encoded
from semid.operators.graphs import view_text, weighted_views

# Weights of a code entity's views, the fields that name a definition's class, and the length of its wiki text.
VIEW_WEIGHTS = {"signature": 0.4, "docstring": 0.2, "body": 0.3, "path": 0.1}
CLASS_FIELDS = ["thingClass", "compClass", "workerClass", "Class"]
WIKI_CHARS = 4000


def code_views(entities: DataFrame) -> DataFrame:
    """Adds ``signature`` (the name where there is none), ``docstring``, ``body`` and ``path`` as views, never null."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entities.withColumns({"signature": F.when(text("signature") != "", F.col("signature")).otherwise(text("name")), "docstring": text("docstring"), "body": text("body"), "path": text("file_path")})


def definition_views(definitions: DataFrame, classes: DataFrame, wiki: DataFrame) -> DataFrame:
    """Adds ``def``, ``label_view``, ``csharp`` and ``wiki`` to definitions (name, def_type, label, description, fields: map of JSON values).

    ``classes`` is (key, text): the text of the class that the first known of the fields that
    name one has, by the last part of its dotted name. ``wiki`` is (slug, text): the page of
    the label, else of the name, cut off after 4,000 characters. What is missing is empty.
    """
    named = lambda f: F.substring_index(F.regexp_extract(F.try_element_at("fields", F.lit(f)), '^"(.*)"$', 1), ".", -1)
    keys = [f"_class{i}" for i in range(len(CLASS_FIELDS))]
    out = definitions.withColumns({k: named(f) for k, f in zip(keys, CLASS_FIELDS, strict=True)})
    out = view_text(out, classes, keys).withColumn("csharp", F.coalesce("text", F.lit(""))).drop("text", *keys)
    out = out.withColumns({"_slug0": slug(F.coalesce("label", F.lit(""))), "_slug1": slug(F.col("name"))})
    pages = wiki.where(F.coalesce("text", F.lit("")) != "").select(F.col("slug").alias("key"), "text")
    out = view_text(out, pages, ["_slug0", "_slug1"]).withColumn("wiki", F.substring(F.coalesce("text", F.lit("")), 1, WIKI_CHARS)).drop("text", "_slug0", "_slug1")
    label = F.btrim(F.concat(F.coalesce("label", F.lit("")), F.lit(". "), F.coalesce("description", F.lit(""))))
    return out.withColumns({"def": definition_blob(F.col("def_type"), F.col("name"), F.col("label"), F.col("description"), F.col("fields")), "label_view": label})


def entity_vectors(entities: DataFrame, weights: dict[str, float] | None = None, encoder: Callable[[], Encoder] | None = None, width: int = 256, name: str = "name", out: str = "vec") -> DataFrame:
    """Adds ``out``: the mean of the vectors of the views that ``weights`` names (columns, of weights above 0), normalised; an empty view is read as the entity's name."""
    used = {v: w for v, w in (weights or VIEW_WEIGHTS).items() if w > 0}
    rows = entities.withColumns({f"_text_{v}": F.when(F.coalesce(F.col(v), F.lit("")) != "", F.col(v)).otherwise(F.col(name)) for v in used})
    for v in used:
        rows = encoded(rows, f"_text_{v}", encoder, width, out=f"_vec_{v}")
    return rows.withColumn(out, weighted_views({v: F.col(f"_vec_{v}") for v in used}, used)).drop(*[f"_{kind}_{v}" for v in used for kind in ("text", "vec")])


def level_accuracy(rows: DataFrame, text: Column, codes: Column, levels: int) -> DataFrame:
    """(level, n, correct, accuracy), levels from 1: how often the code at a level's place among the code tokens of a generated text is the entity's own; a text with fewer tokens is wrong there."""
    said = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("<SID_L\\d+_(\\d+)>"), F.lit(1)), lambda x: x.cast("int"))
    hits = rows.select(codes.alias("c"), said.alias("s")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct((i + 1).alias("level"), F.coalesce(F.get("c", i) == F.get("s", i), F.lit(False)).cast("int").alias("hit")))).alias("x"))
    return hits.groupBy("x.level").agg(F.count("*").alias("n"), F.sum("x.hit").alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))
