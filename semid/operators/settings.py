"""Nested documents (VARIANT): deep merges by priority, overrides and reads by dotted path."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from here on are those of overrides.
ABOVE = 1_000_000

def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.array(text)), "(?s)^\\[(.*)\\]$", 1)


def read(doc: Column, path: str, kind: str = "string", default=None) -> Column:
    """The value at a dotted path of a VARIANT, ``default`` where a part of it is missing or of another kind."""
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    found = F.try_variant_get(doc, at, kind)
    if kind != "variant" and not kind.startswith(("array", "struct", "map")):
        found = F.when(~F.schema_of_variant(F.try_variant_get(doc, at, "variant")).rlike("^(OBJECT|ARRAY)"), found)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def overrides(rows: DataFrame, id_col: str = "id", text_col: str = "override", order_col: str = "n") -> DataFrame:
    """(id, level, path, text) of ``a.b.c=value`` texts in the order of ``order_col``, above all documents: the value, JSON if it reads as such and text if not, replaces all that stood at its path, also where it is an object. A text without ``=`` is an error."""
    at = F.instr(text_col, "=")
    key, text = F.substring(F.col(text_col), F.lit(1), at - 1), F.substring(F.col(text_col), at + 1, F.length(text_col))
    checked = F.when(at > 1, key).otherwise(F.raise_error(F.concat(F.lit("not key=value: "), F.col(text_col))).cast("string"))
    value = F.coalesce(F.try_parse_json(text), F.parse_json(quoted(text)))
    level = (2 * F.col(order_col) + ABOVE).cast("int")
    read_as = rows.select(F.col(id_col).alias("id"), (level + 1).alias("level"), F.split(checked, "[.]").alias("path"), value.alias("doc"))
    # An object first clears its path, one level below its own values.
    clear = read_as.where(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT"))).select("id", (F.col("level") - 1).alias("level"), "path", F.lit(None).cast("string").alias("text"))
    return read_as.select("id", "level", "path", F.to_json("doc").alias("text")).unionByName(clear)


class Number(str):
    """A number as its text, which keeps every digit."""


def _json(node) -> str:
    """A value as JSON text, keys in order; values of the merge stand behind their level."""
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(v)}" for k, v in sorted(node.items())) + "}"
    if isinstance(node, tuple):
        return _json(node[1])
    if isinstance(node, list):
        return "[" + ",".join(map(_json, node)) + "]"
    return str(node) if isinstance(node, Number) else json.dumps(node)


def _lay(tree: dict, over: dict, level: int) -> None:
    """Lays ``over`` on ``tree``, object by object. An empty object replaces nothing but values of lower levels; of two values of one level the greater text stays."""
    for k, v in over.items():
        old = tree.get(k)
        if isinstance(v, dict):
            if not isinstance(old, dict):
                if not v and old is not None and old[0] == level:
                    continue
                old = tree[k] = {}
            _lay(old, v, level)
        elif not (isinstance(old, tuple) and old[0] == level and _json(old) >= _json(v)):
            tree[k] = (level, v)


def deep_merge(docs: DataFrame, id_col: str = "id", doc_col: str = "doc", level_col: str = "level", changes: DataFrame | None = None) -> DataFrame:
    """(id, doc): each id's VARIANT documents merged by ``level_col``, those of a higher level laid over those below, object by object, then changed by ``changes`` (id, override, n). Ids whose documents are all empty or null give none.

    Documents meet in one shuffle by id and are read in order: a task holds what an id's have become so far, never all of them.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), F.col(level_col).cast("int").alias("level"), F.lit(None).cast("array<string>").alias("path"), F.to_json(doc_col).alias("text")).where("text is not null")
    rows = rows if changes is None else rows.unionByName(overrides(changes))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        read_text = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=Number).decode
        last, tree = None, {}  # the whole document stands at the key ""
        for batch in batches:
            ids, out = [], []
            for key, level, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last:
                    if tree.get("", {}) != {}:
                        ids.append(last)
                        out.append(_json(tree[""]))
                    last, tree = key, {}
                value = {} if text is None else read_text(text)
                if text is None:
                    node = tree
                    for p in ["", *path[:-1]]:
                        if not isinstance(node.get(p), dict):
                            node[p] = {}
                        node = node[p]
                    node[path[-1]] = value
                else:
                    for p in reversed(path or []):
                        value = {p: value}
                    _lay(tree, {"": value}, level)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.string())], ["id", "text"])
        if tree.get("", {}) != {}:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([_json(tree[""])], pa.string())], ["id", "text"])

    met = rows.where("id is not null").repartition("id").sortWithinPartitions("id", "level", "path", "text")
    return met.mapInArrow(folded, f"id {dict(rows.dtypes)['id']}, text string").select("id", F.parse_json("text").alias("doc"))
