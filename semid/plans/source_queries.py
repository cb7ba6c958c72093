"""Round trips through sources and sinks, and parsers over files that are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semid.functions.vectors import dot, norm
from semid.operators import quantize as Q
from semid.operators.episodes import STEP
from semid.plans.common import ITEMS_SQL, dot_sql, items, joined, r6, table
from semid.plans.episode_queries import STEPS, steps
from semid.plans.sequence_queries import H, histories
from semid.session import scratch
from semid.sources import csharp, entities, files, sinks
from semid.sources.merging import write_merged
from semid.sources.tfrecord import TFRecordSource


def tfrecord_round_trip(spark, sf_dir):
    """Histories written as records and read in parts of 64 kB, columns and types from the first record."""
    spark.dataSource.register(TFRecordSource)
    path = scratch(spark, "records").removeprefix("file://")
    names = F.transform("seq", lambda x: F.concat(F.lit("i"), x.cast("string")))
    histories(spark, sf_dir).select(F.array("user_id").alias("user"), "seq", names.alias("names"), F.array((F.col("user_id") / 4).cast("float")).alias("share")).write.format("tfrecord").mode("append").save(path)
    back = spark.read.format("tfrecord").option("splitBytes", str(64 << 10)).load(f"{path}/*.tfrecord")
    last = F.decode(F.element_at("names", -1), "UTF-8")
    return back.select(F.get("user", F.lit(0)).alias("user_id"), F.size("seq").alias("n"), joined("seq").alias("seq"), last.alias("last"), r6(F.get("share", F.lit(0)).cast("double")).alias("share"))


def merged_sink_round_trip(spark, sf_dir):
    """Orders through the sink, merged, and what post-processing makes of the stored rows."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").repartition(7)
    post = (lambda x: x.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")), lambda x: x.where("n > 1"))
    return write_merged(rows, scratch(spark, "merged"), post)


def episode_round_trip(spark, sf_dir):
    """Episodes written as one object each and read with the defaults of fields that they lack."""
    path = scratch(spark, "episodes")
    rows = steps(spark, sf_dir).select("episode_id", F.col("step").cast("int").alias("step"), F.col("state").alias("game_state"), F.col("reward"))
    sinks.write_episodes(rows, f"{path}/all/episode.json")
    back = files.episodes(spark, path, lines=True).select("episode_id", "scenario", "difficulty", F.explode("steps").alias("s"))
    return back.select("episode_id", "scenario", "difficulty", F.col("s.step").alias("step"), r6("s.game_state.wealth").alias("wealth"), F.size("s.game_state.colonists").alias("people"), r6(F.col("s.reward")["total"]).alias("total"))


def markdown_corpus(spark, sf_dir):
    """Texts of a table and of markdown files, without blank ones."""
    path, docs = scratch(spark, "notes"), table(spark, sf_dir, "documents")
    notes = docs.where("doc_id % 10 = 0").select(F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("value"))
    notes.repartition(3).write.text(path)
    found = spark.read.text(f"{path}/*.txt").select(F.col("value").alias("text"))
    return files.corpus(spark, [docs.where("doc_id % 10 <> 0"), found]).groupBy(F.length("text").alias("chars")).agg(F.count("*").alias("n"))


def cosine_codes(spark, sf_dir):
    """Nearest of the first eight vectors by another distance: one less the cosine."""
    it = items(spark, sf_dir)
    book = it.where("id < 8").select(F.lit(0).alias("level"), F.col("id").cast("int").alias("code"), "vec")
    far = lambda a, b: F.round(1 - dot(a, b) / (norm(a) * norm(b)), 9)
    return Q.assign(it, book, normalize=False, distance=far).select(F.col("id").alias("vec_id"), F.get("codes", F.lit(0)).alias("code"))


SHELL = """// class Note { }
namespace Acme.N%d
{
  [Tag("class Quoted {")]
  public partial class Comp%d<T> : Base<T, int>, IThing where T : new()
  {
    private static readonly Dictionary<string, List<int>> map = new Dictionary<string, List<int>>(), more = null;
    const string Text = "} class Fake { void M() { } }";
    public int Count { get; set; }
    public override void Tick() { if (a < 2) { Call("}"); } }
    (int, string) Pair(int q = %d) => (q, $"{(q > 1 ? "x}" : "y")}");
    enum Kind { A, B }
    struct Inner { public int v; void Go() { } }
  }
  partial class Comp%d<T> { int later; void Tock() { } }
}
"""


def csharp_nested_types(spark, sf_dir):
    """A source for each customer: quoted braces, comments, generics, nested types and a partial type in two parts."""
    c = table(spark, sf_dir, "customer")
    text = F.format_string(SHELL.replace("\n", "%n"), "c_nationkey", "c_custkey", "c_nationkey", "c_custkey")
    found = csharp.csharp_types(c.select(F.concat(F.lit("c"), "c_custkey", F.lit(".cs")).alias("rel_path"), text.alias("text")), roots=("Acme",))
    whole = csharp.whole_types(found)
    blob = csharp.type_blob(*map(F.col, ("kind", "namespace", "name", "parent", "methods", "fields")))
    return whole.groupBy("name", "kind", "parent", F.array_join("methods", ",").alias("methods"), F.array_join("fields", ",").alias("fields"), "parts", F.length(blob).alias("blob_chars")).agg(F.count("*").alias("n"))


# Definitions, one for each rule of categories: type, its fields, and the category and sub-category they belong to.
CASES = [
    ("ResearchProjectDef", {"techLevel": '"Industrial"'}, "Research", "Industrial"), ("ResearchProjectDef", {}, "Research", "Neolithic"), ("WorkTypeDef", {}, "Jobs", "WorkType"), ("JobDef", {}, "Jobs", "Job"),
    ("IncidentDef", {"category": '"ThreatBig"'}, "Events", "Threats"), ("QuestScriptDef", {"defName": '"RaidCamp"'}, "Events", "Threats"), ("IncidentDef", {"category": '"Misc"'}, "Events", "Opportunities"),
    ("ThingDef", {"building.x": "1", "thingCategories": '["BuildingsPower"]'}, "Buildings", "Power"), ("ThingDef", {"building": "1", "thingCategories": '["BuildingsProduction"]'}, "Buildings", "Production"),
    ("ThingDef", {"thingClass": '"Building_Turret"', "thingCategories": '["BuildingsSecurity"]'}, "Buildings", "Security"), ("ThingDef", {"building": "1", "thingCategories": '["BuildingsFurniture"]'}, "Buildings", "Furniture"), ("ThingDef", {"thingClass": '"Building"'}, "Buildings", "Structure"),
    ("ThingDef", {"thingCategories": '["WeaponsRanged"]'}, "Items", "Weapons"), ("ThingDef", {"thingCategories": '["Apparel"]'}, "Items", "Apparel"), ("ThingDef", {"thingCategories": '["FoodMeals"]'}, "Items", "Meals"), ("ThingDef", {"thingCategories": '["ResourcesRaw"]'}, "Items", "Meals"),
    ("ThingDef", {"thingCategories": '["Manufactured"]'}, "Items", "Resources"), ("ThingDef", {}, "Items", "Other"), ("HediffDef", {}, "Misc", "HediffDef"),
]


def category_cases(spark, sf_dir):
    """Parts as definitions that reach each rule in turn."""
    fields = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    cases = F.array(*[F.struct(F.lit(t).alias("t"), fields(d).alias("d")) for t, d, _, _ in CASES])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(cases, (F.col("p_partkey") % len(CASES)).cast("int")).alias("c"))
    return rows.select("p_partkey", entities.category(F.col("c.t"), F.col("c.d")).alias("k")).select("p_partkey", "k.category", "k.subcategory")


NAMES = "tfrecord_round_trip merged_sink_round_trip episode_round_trip markdown_corpus cosine_codes csharp_nested_types category_cases".split()
QUERIES = {n: globals()[n] for n in NAMES}
COSINE = f"round(1 - {dot_sql('i.vec', 'c.vec')} / (sqrt({dot_sql('i.vec', 'i.vec')}) * sqrt({dot_sql('c.vec', 'c.vec')})), 9)"
TYPES = "SELECT '{0}' AS name, '{1}' AS kind, {2} AS parent, '{3}' AS methods, '{4}' AS fields, 1 AS parts, {5} AS blob_chars, count(*) AS n FROM customer GROUP BY blob_chars"
ORACLES = {
    "tfrecord_round_trip": f"WITH {H} SELECT user_id, CAST(len(seq) AS INTEGER) AS n, array_to_string(seq, ',') AS seq, 'i' || seq[-1] AS last, round(CAST(user_id / 4 AS DOUBLE), 6) AS share FROM h",
    "merged_sink_round_trip": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "episode_round_trip": f"WITH {STEPS} SELECT episode_id, 'crashlanded' AS scenario, 'strive_to_survive' AS difficulty, step, round(value, 6) AS wealth, CAST(len(names) AS INTEGER) AS people, round(value, 6) AS total FROM t",
    "markdown_corpus": "SELECT CAST(length(text) AS INTEGER) AS chars, count(*) AS n FROM documents WHERE trim(text, ' ') <> '' GROUP BY 1",
    "cosine_codes": f"WITH {ITEMS_SQL}, c AS (SELECT id AS code, vec FROM it WHERE id < 8), d AS (SELECT i.id, c.code, {COSINE} AS far FROM it i, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, code) AS rn FROM d) SELECT id AS vec_id, CAST(code AS INTEGER) AS code FROM r WHERE rn = 1",
    "csharp_nested_types": f"""{TYPES.format("Kind", "enum", "NULL", "", "", "length('enum Acme.N' || c_nationkey || '.Kind') + 19")} UNION ALL {TYPES.format("Inner", "struct", "NULL", "Go", "v", "length('struct Acme.N' || c_nationkey || '.Inner') + 22")}
        UNION ALL SELECT 'Comp' || c_custkey, 'class', 'Base<T,int>', 'Tick,Pair,Tock', 'map,more,Text,later', 2, length('class Acme.N' || c_nationkey || '.Comp' || c_custkey || ' : Base<T,int>') + 57, count(*) FROM customer GROUP BY c_custkey, c_nationkey""",
    "category_cases": f"SELECT p_partkey, [{', '.join(repr(c) for _, _, c, _ in CASES)}][p_partkey % {len(CASES)} + 1] AS category, [{', '.join(repr(c) for _, _, _, c in CASES)}][p_partkey % {len(CASES)} + 1] AS subcategory FROM part",
}
