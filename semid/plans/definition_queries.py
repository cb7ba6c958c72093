"""Queries of parsers, over sources and definitions written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.functions.text import sid_sequence
from semid.operators import views
from semid.operators.graphs import class_links, view_text
from semid.plans.common import r6, table
from semid.plans.quantize_queries import assigned, residual_sql
from semid.plans.text_queries import letter_encoder
from semid.sources import entities as N
from semid.sources.files import event_lines, parse_state, split_outputs


def _python_files(spark, sf_dir):
    """A class and a function a nation."""
    n = table(spark, sf_dir, "nation")
    text = F.format_string('class C%d:\n    """Doc of %s."""\n\n    def load(self):\n        return %d\n\n    def check(self):\n        def inner():\n            return 1\n        return inner()\n\n\ndef top_%d(x):\n    return x\n', "n_nationkey", "n_name", "n_regionkey", "n_nationkey")
    return n.select(F.concat(F.lit("f"), "n_nationkey", F.lit(".py")).alias("rel_path"), text.alias("text"))


def extract_python_entities(spark, sf_dir):
    x = N.extract_entities(_python_files(spark, sf_dir))
    return x.select(N.entity_uid(F.col("file_path"), F.col("parent"), F.col("name")).alias("uid"), "kind", "signature", F.array_join("children", ",").alias("children"), "start_line", "end_line")


def extract_csharp_entities(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.format_string("namespace Acme.N%d\n{\n  public class Comp%d : ThingComp\n  {\n    public override void Tick() { }\n    private int Count(int x) { return x; }\n  }\n}\n", "n_regionkey", "n_nationkey")
    x = N.extract_entities(n.select(F.concat(F.lit("f"), "n_nationkey", F.lit(".cs")).alias("rel_path"), text.alias("text")), "csharp", roots=("Acme",))
    return x.select("name", "kind", "parent", F.array_join("children", ",").alias("methods"))


def _xml(spark, sf_dir):
    """An abstract definition a region, which the nations' inherit from."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.format_string('<ThingDef Abstract="True" Name="Base%d"><thingCategories><li>Apparel%d</li></thingCategories><stat><hp>%d</hp><mass>1</mass></stat></ThingDef>', "r_regionkey", "r_regionkey", "r_regionkey")
    own = F.format_string('<ThingDef ParentName="Base%d"><!-- x --><defName>Thing%d</defName><label>%s</label><stat><mass>%d</mass></stat><next>Thing%d</next></ThingDef>', "r_regionkey", "n_nationkey", "n_name", "n_nationkey", F.pmod(F.col("n_nationkey") + 1, F.lit(25)))
    return n.groupBy("r_regionkey").agg(F.concat(F.lit("<Defs>"), F.first(base), F.array_join(F.array_sort(F.collect_list(own)), ""), F.lit("</Defs>")).alias("text")).select(F.concat(F.lit("d"), "r_regionkey", F.lit(".xml")).alias("path"), "text")


def xml_defs(spark, sf_dir):
    x = N.xml_definitions(_xml(spark, sf_dir), ["ThingDef"])
    return x.select("name", "def_type", "parent", F.try_element_at("fields", F.lit("stat.hp")).alias("hp"), F.try_element_at("fields", F.lit("stat.mass")).alias("mass"), F.array_join("references", ",").alias("refs"))


def category_rules(spark, sf_dir):
    x = N.xml_definitions(_xml(spark, sf_dir), ["ThingDef"])
    nodes = x.select("name", N.category(F.col("def_type"), F.col("fields")).alias("c")).select("name", "c.category", "c.subcategory")
    return N.category_tree(nodes).select("category", "subcategory", F.array_join("names", ",").alias("names"))


def class_link_join(spark, sf_dir):
    values = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.concat(F.lit("Acme.Comp"), F.col("n_regionkey")).alias("value"))
    classes = table(spark, sf_dir, "region").select(F.concat(F.lit("Comp"), F.col("r_regionkey")).alias("class"))
    return class_links(values, classes).select("class", F.array_join("defs", ",").alias("defs"))


def view_lookup(spark, sf_dir):
    blobs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("text"))
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("k"), F.col("n_nationkey")).alias("first"), F.col("n_regionkey").cast("string").alias("second"))
    return view_text(d, blobs, ["first", "second"]).select("n_nationkey", "text")


def definition_view_texts(spark, sf_dir):
    """Parts as definitions, with the text of the class that one of two fields names and with their wiki pages, of which long ones are cut."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    number = F.substring("p_brand", 7, 2)
    fields = F.when(k % 3 == 0, F.create_map(F.lit("thingClass"), F.concat(F.lit('"Depot.T'), number, F.lit('"')))).when(k % 3 == 1, F.create_map(F.lit("thingClass"), F.lit('"Depot.None"'), F.lit("Class"), F.concat(F.lit('"T'), number, F.lit('"')))).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    d = p.select(F.concat(F.lit("P"), k).alias("name"), F.col("p_type").alias("def_type"), F.when(k % 4 > 0, F.concat(F.lit("Tall "), k)).alias("label"), F.when(k % 2 > 0, F.col("p_name")).alias("description"), fields.alias("fields"))
    classes = p.select(number.alias("n")).distinct().where("n > '22'").select(F.concat(F.lit("T"), "n").alias("key"), F.concat(F.lit("class T"), "n").alias("text"))
    wiki = p.select(F.when(k % 5 == 0, F.concat(F.lit("tall_"), k)).when(k % 5 == 1, F.concat(F.lit("p"), k)).alias("slug"), F.when(k % 2 == 0, F.repeat(F.lit("w"), 5000)).otherwise(F.concat(F.lit("about "), k)).alias("text")).where("slug is not null")
    out = views.definition_views(d, classes, wiki)
    return out.select("name", F.md5("def").alias("def"), F.col("label_view").alias("label"), "csharp", F.length("wiki").alias("wiki_chars"))


def entity_view_vectors(spark, sf_dir):
    """Parts as entities of four views, by a plugged-in encoder."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("signature"), F.lit(None).cast("string").alias("docstring"), F.concat("p_type", F.lit(" e "), "p_name").alias("body"), F.col("p_brand").alias("file_path"))
    out = views.entity_vectors(views.code_views(p), encoder=letter_encoder)
    return out.select("p_partkey", *[r6(F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(3)])


def level_accuracy(spark, sf_dir):
    """Texts that name the second code of every third item wrong, and nothing of every fifth."""
    a = assigned(spark, sf_dir)
    wrong = F.transform("codes", lambda c, i: F.when((i == 1) & (F.col("id") % 3 == 0), c + 1).otherwise(c))
    text = F.when(F.col("id") % 5 == 0, "none").otherwise(F.concat(F.lit("so "), sid_sequence(wrong, 2, False), F.lit(" it is")))
    return views.level_accuracy(a, text, F.col("codes"), 2)


def event_line_parse(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    lines = ev.select(F.when(F.col("event_id") % 3 == 0, F.lit(": ping")).otherwise(F.concat(F.lit("data: "), "props")).alias("value"), "event_id")
    return event_lines(lines, "k long").groupBy("k").agg(F.count("*").alias("n"))


def live_state_parse(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"wealth": "'), F.col("event_id").cast("string"), F.lit('", "day": '), (F.col("event_id") % 9).cast("string"), F.lit(', "resources": {"wood": "'), F.when(F.col("event_id") % 2 == 0, "x").otherwise("3"), F.lit('"}}'))
    s = parse_state(raw)
    return ev.select("event_id", s.alias("s")).select("event_id", F.col("s.wealth").alias("wealth"), F.col("s.day").alias("day"), F.try_element_at("s.resources", F.lit("wood")).alias("wood"), F.size("s.colonists").alias("colonists"))


def planning_output_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n===\n").alias("value"))
    return split_outputs(c).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


NAMES = "definition_view_texts entity_view_vectors level_accuracy extract_python_entities extract_csharp_entities xml_defs category_rules class_link_join view_lookup event_line_parse live_state_parse planning_output_split".split()
QUERIES = {n: globals()[n] for n in NAMES}
def _letters(text: str) -> str:
    v = f"[CAST(length({text}) AS DOUBLE), length({text}) - length(replace({text}, 'e', '')), length({text}) - length(replace({text}, ' ', ''))]"
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-12))"


ORACLES = {
    "definition_view_texts": """WITH p AS (SELECT *, p_partkey AS k, substr(p_brand, 7, 2) AS n FROM part),
        w AS (SELECT CASE k % 5 WHEN 0 THEN 'tall_' || k WHEN 1 THEN 'p' || k END AS slug, CASE WHEN k % 2 = 0 THEN 4000 ELSE length('about ' || k) END AS chars FROM p WHERE k % 5 < 2)
        SELECT 'P' || k AS name, coalesce(CASE WHEN k % 4 > 0 THEN 'Tall ' || k END, '') || '.' || CASE WHEN k % 2 > 0 THEN ' ' || p_name ELSE '' END AS label,
          md5(concat_ws(chr(10), p_type || ' P' || k, CASE WHEN k % 4 > 0 THEN 'Tall ' || k END, CASE WHEN k % 2 > 0 THEN p_name END, CASE k % 3 WHEN 0 THEN 'thingClass: "Depot.T' || n || '"' WHEN 1 THEN 'thingClass: "Depot.None"' || chr(10) || 'Class: "T' || n || '"' ELSE 'size: ' || p_size END)) AS def,
          CASE WHEN k % 3 < 2 AND n > '22' THEN 'class T' || n ELSE '' END AS csharp, CAST(coalesce((SELECT chars FROM w WHERE slug = 'tall_' || k AND k % 4 > 0), (SELECT chars FROM w WHERE slug = 'p' || k), 0) AS INTEGER) AS wiki_chars FROM p""",
    "entity_view_vectors": f"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS s, p_name AS d, p_type || ' e ' || p_name AS b, p_brand AS f FROM part),
        e AS (SELECT p_partkey, {_letters('s')} AS s, {_letters('d')} AS d, {_letters('b')} AS b, {_letters('f')} AS f FROM x), m AS (SELECT p_partkey, list_transform(range(1, 4), lambda i: 0.4::DOUBLE * s[i] + 0.2::DOUBLE * d[i] + 0.3::DOUBLE * b[i] + 0.1::DOUBLE * f[i]) AS v FROM e),
        n AS (SELECT p_partkey, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM m) SELECT p_partkey, round(v[1] / n, 6) AS v0, round(v[2] / n, 6) AS v1, round(v[3] / n, 6) AS v2 FROM n""",
    "level_accuracy": f"WITH {residual_sql()}, h AS (SELECT 1 AS level, CAST(id % 5 <> 0 AS INTEGER) AS hit FROM a UNION ALL SELECT 2, CAST(id % 5 <> 0 AND id % 3 <> 0 AS INTEGER) FROM a) SELECT level, count(*) AS n, CAST(sum(hit) AS BIGINT) AS correct, round(sum(hit) / count(*), 4) AS accuracy FROM h GROUP BY level",
    "extract_python_entities": "SELECT unnest(['f' || k || '.py::C' || k, 'f' || k || '.py::C' || k || '.load', 'f' || k || '.py::C' || k || '.check', 'f' || k || '.py::C' || k || '.inner', 'f' || k || '.py::top_' || k]) AS uid, unnest(['class', 'method', 'method', 'method', 'function']) AS kind, unnest(['class C' || k || ':', 'def load(self):', 'def check(self):', 'def inner():', 'def top_' || k || '(x):']) AS signature, unnest(['load,check', '', '', '', '']) AS children, unnest([1, 4, 7, 8, 13]) AS start_line, unnest([10, 5, 10, 9, 14]) AS end_line FROM (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation)",
    "extract_csharp_entities": "SELECT 'Comp' || n_nationkey AS name, 'class' AS kind, 'ThingComp' AS parent, 'Tick,Count' AS methods FROM nation",
    "xml_defs": "SELECT 'Thing' || n_nationkey AS name, 'ThingDef' AS def_type, 'Base' || n_regionkey AS parent, '\"' || n_regionkey || '\"' AS hp, '\"' || n_nationkey || '\"' AS mass, 'Thing' || ((n_nationkey + 1) % 25) AS refs FROM nation",
    "category_rules": "SELECT 'Items' AS category, 'Apparel' AS subcategory, string_agg('Thing' || n_nationkey, ',' ORDER BY 'Thing' || n_nationkey) AS names FROM nation",
    "class_link_join": "SELECT 'Comp' || n_regionkey AS class, string_agg(n_name, ',' ORDER BY n_nationkey) AS defs FROM nation GROUP BY n_regionkey",
    "view_lookup": "SELECT n_nationkey, r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "event_line_parse": "SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "live_state_parse": "SELECT event_id, CAST(event_id AS DOUBLE) AS wealth, CAST(event_id % 9 AS INTEGER) AS day, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3 END AS DOUBLE) AS wood, 0 AS colonists FROM events",
    "planning_output_split": "WITH c AS (SELECT text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY pos",
}
