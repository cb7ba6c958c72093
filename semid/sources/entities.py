"""Parsers that turn one file into many entities: Python and C# sources, XML definitions."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semid.operators.graphs import children, inherited_fields, references
from semid.sources.csharp import types

ENTITY = "name string, kind string, file_path string, body string, signature string, docstring string, parent string, children array<string>, language string, start_line int, end_line int"
DEFINITION = "pos bigint, name string, handle string, def_type string, parent string, abstract boolean, label string, description string, path string, value string, file_path string"


def python_entities(text: str, file_path: str) -> Iterator[tuple]:
    """Classes and functions. A function directly or indirectly within a class is a method of it."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.splitlines(keepends=True)

    def walk(node, owner: str | None) -> Iterator[tuple]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                body = "".join(lines[n.lineno - 1 : n.end_lineno])
                members = [m.name for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)] if is_class else []
                kind = "class" if is_class else "method" if owner else "function"
                yield n.name, kind, file_path, body, body.split("\n", 1)[0].strip(), ast.get_docstring(n), None if is_class else owner, members, "python", n.lineno, n.end_lineno
                yield from walk(n, n.name if is_class else owner)
            else:
                yield from walk(n, owner)

    yield from walk(tree, None)


def csharp_entities(text: str, file_path: str, roots: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Types of C# sources: name, kind, first base (as ``parent``) and methods; only of namespaces below ``roots``, if given."""
    for t in types(text):
        if not roots or t.namespace.split(".")[0] in roots:
            body, line = text[t.start : t.end], text.count("\n", 0, t.start) + 1
            yield t.name, t.kind, file_path, body, body.split("\n", 1)[0].strip(), None, t.parent, list(dict.fromkeys(t.methods)), "csharp", line, line + body.count("\n")


def extract_entities(files: DataFrame, language: str = "python", **options) -> DataFrame:
    """One row an entity of ``files`` (rel_path, text); files that do not parse give none."""
    import pyarrow as pa

    parse = {"python": python_entities, "csharp": csharp_entities}[language]
    names = [c.split(" ", 1)[0] for c in ENTITY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, e, strict=True)) for path, text in zip(batch.column("rel_path").to_pylist(), batch.column("text").to_pylist(), strict=True) for e in parse(text or "", path, **options)]
            kinds = {"children": pa.list_(pa.string()), "start_line": pa.int32(), "end_line": pa.int32()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds.get(n, pa.string())) for n in names]))

    return files.select("rel_path", "text").mapInArrow(run, ENTITY)


def entity_uid(file_path: Column, parent: Column, name: Column) -> Column:
    return F.concat(file_path, F.lit("::"), F.coalesce(F.concat(parent, F.lit(".")), F.lit("")), name)


def xml_value(element):
    """Text of a leaf, a list where all children are ``li``, else a mapping in which the last of equal tags wins."""
    kids = list(element)
    if not kids:
        return (element.text or "").strip()
    if all(k.tag == "li" for k in kids):
        return [xml_value(k) for k in kids]
    return {k.tag: xml_value(k) for k in kids}


def _leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    else:
        yield path, json.dumps(value)


def xml_leaves(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """A row for each leaf of each definition in ``files`` (path, text); lists are one leaf; values are JSON. Comments go; files that do not parse give no rows."""
    import pyarrow as pa

    fields = [("pos", pa.int64()), *[(n, pa.string()) for n in ("name", "handle", "def_type", "parent")], ("abstract", pa.bool_()), *[(n, pa.string()) for n in ("label", "description", "path", "value", "file_path")]]

    def definitions(path: str, text: str) -> Iterator[dict]:
        from xml.etree import ElementTree

        try:
            root = ElementTree.fromstring(re.sub(r"<!--.*?-->", "", text, flags=re.S).encode())
        except ElementTree.ParseError:
            return
        for pos, d in enumerate(root):
            if types and d.tag not in types:
                continue
            value = xml_value(d)
            value = value if isinstance(value, dict) else {}
            name = value.get("defName") or d.get("Name") or ""
            head = {"pos": pos, "name": name, "handle": d.get("Name") or name, "def_type": d.tag, "parent": d.get("ParentName"), "abstract": (d.get("Abstract") or "").lower() == "true", "label": value.get("label"), "description": value.get("description"), "file_path": path}
            for leaf, v in list(_leaves(value)) or [("", "null")]:
                yield head | {"path": leaf, "value": v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in definitions(path, text or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return files.select("path", "text").mapInArrow(run, DEFINITION)


def xml_definitions(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """One row a concrete definition: name, type, parent, namespace, its own and inherited fields (map of JSON values by path), children and references."""
    leaves = xml_leaves(files, types).where("handle <> ''")
    heads = leaves.groupBy("handle").agg(*[F.max_by(c, F.struct("file_path", "pos")).alias(c) for c in ("name", "def_type", "parent", "abstract", "label", "description", "file_path")])
    links = heads.select(F.col("handle").alias("name"), "parent")
    fields = inherited_fields(links, leaves.select(F.col("handle").alias("name"), "path", "value").where("path <> ''"))
    texts = fields.select("name", F.explode(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array(F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")))).alias("value"))
    refs = references(texts, heads.where("not abstract").select("name"))
    maps = fields.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("fields"))
    out = heads.join(maps.withColumnRenamed("name", "handle"), "handle", "left").join(children(links).withColumnRenamed("name", "handle"), "handle").join(refs, "name", "left")
    # The two namespaces that definitions are filed under.
    space = F.when(F.col("def_type").isin("JobDef", "WorkTypeDef"), "Verse").otherwise("RimWorld")
    return out.where("not abstract and name <> ''").select("name", "def_type", "label", "description", "parent", "fields", "file_path", space.alias("namespace"), "children", F.coalesce("refs", F.array().cast("array<string>")).alias("references"))


def category(def_type: Column, fields: Column) -> Column:
    """A struct (category, subcategory) of a definition. The words, categories and their order are fixed; the first rule that holds decides."""
    get = lambda name: F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))
    kinds = F.lower(get("thingCategories"))
    building = F.exists(F.map_keys(fields), lambda k: (k == "building") | k.startswith("building.")) | F.contains(get("thingClass"), F.lit("Building"))
    has = lambda *words: kinds.rlike("|".join(words))
    pair = lambda a, b: F.struct(F.lit(a).alias("category"), (F.lit(b) if isinstance(b, str) else b).alias("subcategory"))
    thing = (
        F.when(building & has("power", "battery", "generator", "solar"), pair("Buildings", "Power"))
        .when(building & has("production", "workbench", "smelter"), pair("Buildings", "Production"))
        .when(building & has("security", "turret", "sandbag"), pair("Buildings", "Security"))
        .when(building & has("furniture", "bed", "table", "chair"), pair("Buildings", "Furniture"))
        .when(building, pair("Buildings", "Structure"))
        .when(has("weapon", "gun", "melee"), pair("Items", "Weapons"))
        .when(has("apparel", "clothing", "armor"), pair("Items", "Apparel"))
        .when(has("food", "meal", "meat", "raw"), pair("Items", "Meals"))
        .when(has("resource", "manufactured", "stuff", "metal", "wood"), pair("Items", "Resources"))
        .otherwise(pair("Items", "Other"))
    )
    tech = F.coalesce(F.replace(F.try_element_at(fields, F.lit("techLevel")), F.lit('"'), F.lit("")), F.lit("Neolithic"))
    threat = F.contains(get("category"), F.lit("Threat")) | F.contains(get("defName"), F.lit("Raid"))
    return (
        F.when(def_type == "ResearchProjectDef", pair("Research", tech))
        .when(def_type == "WorkTypeDef", pair("Jobs", "WorkType"))
        .when(def_type == "JobDef", pair("Jobs", "Job"))
        .when(def_type.isin("IncidentDef", "QuestScriptDef"), pair("Events", F.when(threat, "Threats").otherwise("Opportunities")))
        .when(def_type == "ThingDef", thing)
        .otherwise(pair("Misc", def_type))
    )


def category_tree(nodes: DataFrame) -> DataFrame:
    """(category, subcategory, names) with sorted names."""
    return nodes.groupBy("category", "subcategory").agg(F.sort_array(F.collect_list("name")).alias("names"))
