"""Small inputs with known results."""

import math
import re

import pytest
from pyspark.sql import functions as F

from semid.functions import text as T
from semid.functions import vectors as V
from semid.operators import episodes as E
from semid.operators import graphs as G
from semid.operators import quantize as Q
from semid.operators import retrieval as R
from semid.operators import sampling as S
from semid.operators import sequences as Q2
from semid.sources import entities as N
from semid.sources import files, sinks
from semid.sources.tfrecord import TFRecordSource, decode_example, encode_example, frame


def one(spark, *cols, rows=((0,),), schema="x int"):
    return tuple(spark.createDataFrame(list(rows), schema).select(*cols).first())


def test_python_entities(spark):
    src = 'import os\n\nclass Ledger(dict):\n    """What is owed."""\n    limit = 3\n\n    def add(self, x):\n        def inner():\n            pass\n        return inner\n\n    async def close(self):\n        pass\n\n    class Page:\n        def turn(self):\n            pass\n\n\ndef opened():\n    return Ledger()\n'
    rows = {r["name"]: r for r in N.extract_entities(spark.createDataFrame([("z.py", src), ("broken.py", "def ("), ("none.py", None)], "rel_path string, text string")).collect()}
    assert {n: (r["kind"], r["parent"]) for n, r in rows.items()} == {"Ledger": ("class", None), "add": ("method", "Ledger"), "inner": ("method", "Ledger"), "close": ("method", "Ledger"), "Page": ("class", None), "turn": ("method", "Page"), "opened": ("function", None)}
    assert rows["Ledger"]["children"] == ["add", "close"] and rows["Ledger"]["docstring"] == "What is owed." and rows["opened"]["body"] == "def opened():\n    return Ledger()\n"


def test_sid_tokens(spark):
    assert T.code_width(64) == 2 and T.code_width(256) == 3
    x = F.array(*[F.lit(i) for i in (1, 2, 3)])
    got = one(spark, T.sid_token(1, F.lit(7), 2), T.sid_sequence(x, 2, False), T.parse_sid(F.lit("<SID_L2_05>")), T.parse_sid(F.lit("<SID_START>")), T.sid_token(1, F.lit(1234), 2))
    assert got[0] == "<SID_L1_07>" and got[1] == "<SID_L1_01><SID_L2_02><SID_L3_03>" and tuple(got[2]) == (1, 5) and got[3] is None and got[4] == "<SID_L1_1234>"
    vocab = T.sid_vocabulary(spark, 3, 64).collect()
    assert len(vocab) == 200 and {r["idx"]: r["token"] for r in vocab}[64] == "<SID_L2_00>"


def test_subtoken_means(spark):
    old = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 2.0])], "id int, vec array<double>")
    new = spark.createDataFrame([("a", [0, 2]), ("b", [])], "token string, ids array<int>")
    got = {r["token"]: r["vec"] for r in Q2.subtoken_means(new, old, 2).collect()}
    assert got["a"] == [2.0, 1.0] and got["b"] == pytest.approx([4 / 3, 1.0])
    got = {r["token"]: r["vec"] for r in Q2.subtoken_means(new, old, 2, 0.5).collect()}
    assert got["a"] == pytest.approx([2 / 3 + 1, 2 / 3])
    rows = Q.project_rows([[1.0, 2.0], [3.0, 4.0]], 8, 0.7, 1)
    assert rows == Q.project_rows([[1.0, 2.0], [3.0, 4.0]], 8, 0.7, 1) and all(abs(math.hypot(*r) - 0.7) < 1e-4 for r in rows)


def test_commit_graph(spark):
    log = spark.createDataFrame([("__COMMIT__\nlib/x.rs\nlib/y.rs\nREADME\n__COMMIT__\nlib/y.rs\n",)], "text string")
    assert [set(r["files"]) for r in G.parse_commit_log(log).orderBy("commit_id").collect()] == [{"lib/x.rs", "lib/y.rs", "README"}, {"lib/y.rs"}]
    # p goes with q three times and with r once, and each of them goes with p alone.
    pairs = spark.createDataFrame([(g, f) for g, fs in enumerate(["pq", "pq", "pq", "pr"]) for f in fs], "g int, f string")
    got = {(r["src"], r["dst"]): r["w"] for r in G.cooccurrence_graph(pairs, "g", "f").collect()}
    assert got == {("p", "q"): pytest.approx(0.75), ("p", "r"): pytest.approx(0.25), ("q", "p"): 1, ("r", "p"): 1}
    big = spark.createDataFrame([(1, f"f{i}") for i in range(51)] + [(2, "f0"), (2, "f0"), (3, None)], "g int, f string")
    assert G.cooccurrence_graph(big, "g", "f").count() == 0
    vecs = spark.createDataFrame([("p", [3.0, 0.0]), ("q", [0.0, 2.0])], "key string, vec array<double>")
    graph = spark.createDataFrame([("p", "q", 1.0), ("q", "p", 1.0)], "src string, dst string, w double")
    out = {r["key"]: r["vec"] for r in G.smooth(vecs, graph, 2, 0.25).collect()}
    assert sum(x * y for x, y in zip(out["p"], out["q"], strict=True)) > 0.5 and math.hypot(*out["p"]) == pytest.approx(1)
    assert G.smooth(vecs, graph, 2, enabled=False) is vecs


def _chain(parents, name):
    """A name and its ancestors, up to a missing parent or a name seen before."""
    out = [name]
    while (p := parents.get(out[-1])) in parents and p not in out:
        out.append(p)
    return out


def test_inheritance_of_any_depth_and_in_circles(spark):
    parents = {f"n{i}": f"n{i + 1}" for i in range(150)} | {"n150": None, "lost": "gone", "self": "self", "to self": "self"}
    parents |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"t0": "t1", "t1": "t2", "t2": "c3", "a": "b", "b": "a"}
    d = spark.createDataFrame(list(parents.items()), "name string, parent string")
    got = sorted((r["name"], r["depth"], r["ancestor"]) for r in G.ancestors(d).collect())
    assert got == sorted((n, k, a) for n in parents for k, a in enumerate(_chain(parents, n)))
    assert G.ancestors(d.limit(0)).count() == 0


def test_xml(spark):
    xml = """<Defs><ThingDef Abstract="True" Name="LampBase"><statBases><Beauty>4</Beauty><Mass>2</Mass></statBases><tags><li>Light</li></tags></ThingDef>
    <ThingDef ParentName="LampBase"><defName>Lamp_Desk</defName><label>desk lamp</label><statBases><Mass>1</Mass></statBases></ThingDef><ResearchProjectDef><defName>Glass</defName></ResearchProjectDef></Defs>"""
    got = N.xml_definitions(spark.createDataFrame([("lamps.xml", xml), ("bad.xml", "<broken")], "path string, text string"))
    rows = {r["name"]: r for r in got.select("*", N.category(F.col("def_type"), F.col("fields")).alias("c")).collect()}
    assert set(rows) == {"Lamp_Desk", "Glass"} and rows["Glass"]["c"]["category"] == "Research"
    assert {k: rows["Lamp_Desk"]["fields"][k] for k in ("statBases.Beauty", "statBases.Mass", "tags")} == {"statBases.Beauty": '"4"', "statBases.Mass": '"1"', "tags": '["Light"]'}


@pytest.mark.parametrize(("text", "want"), [("1/3", 1 / 3), ("40%", 0.4), ("0.7", 0.7), ("3/3", 1.0), ("garbage", 0.0), ("5/4", 1.25), ("150%", 1.0), ("1/0", 0.0), (None, 0.0)])
def test_progress(spark, text, want):
    assert one(spark, E.parse_progress(F.col("t")), rows=[(text,)], schema="t string")[0] == pytest.approx(want)


def test_rewards(spark):
    base = {"colonists": [("a", 0.5, 1.0, "Build")], "resources": {}, "research_progress": {}, "threats": [], "quests_active": [], "season": "", "day": 1, "temperature": 0.0, "wealth": 0.0}

    def total(before, after, actions, **w):
        df = spark.createDataFrame([({**base, **before}, {**base, **after}, actions)], f"a {E.STATE}, b {E.STATE}, acts array<struct<action: string>>")
        return df.select(E.reward(F.col("a"), F.col("b"), F.col("acts"), **w).alias("r")).first()["r"]

    go = [("order_mine",)]
    assert total({"quests_active": [("q", "1/3")]}, {"quests_active": [("q", "2/3")]}, go)["total"] == pytest.approx(2 / 3)
    assert total({}, {"colonists": []}, go)["death_penalty"] == -10
    assert total({}, {"colonists": [("a", 0.5, 1.0, "idle")]}, go)["total"] == pytest.approx(-0.1)
    assert total({}, {}, [("wait",)])["total"] == -0.5 and total({}, {}, [])["total"] == 0
    assert total({"research_progress": {"x": 0.1}}, {"research_progress": {"x": 0.3}}, go)["total"] == pytest.approx(0.3)
    assert total({}, {"colonists": [("a", 0.7, 1.0, "Build")]}, go)["total"] == pytest.approx(0.2)
    assert total({"resources": {"buildings": 2.0}}, {"resources": {"buildings": 4.0}}, go)["total"] == pytest.approx(1.0)
    assert total({}, {}, go, invalid=F.lit(1))["total"] == pytest.approx(-0.3)


def test_action_round_trip(spark):
    text = "think <SID:1-2>\n<ACTION_START>\n<ACT:order_build>\n<PARAM:def_name=Wall>\n<PARAM:x=1>\n<PARAM:x=42>\n<PARAM:y=18>\n<REASON>need\npower</REASON>\n<ACTION_END>\n<ACTION_START>\n<ACT:fly>\n<ACTION_END>"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, t string")
    rows = E.validity(E.parse_actions(df, "id", "t")).orderBy("pos").collect()
    assert [r["valid"] for r in rows] == [True, False] and rows[0]["params"] == {"def_name": "Wall", "x": "42", "y": "18"} and rows[0]["reason"] == "need\npower"
    s = {r["id"]: r for r in E.planning_scores(df, "id", "t").collect()}
    assert s[1]["num_valid"] == 1 and s[1]["uses_sid"] and s[2]["num_actions"] == 0 and not s[2]["count_ok"]
    t = one(spark, E.typed(F.lit("42")), E.typed(F.lit("1.5")), E.typed(F.lit("x")))
    assert [tuple(v) for v in t] == [(42, None, None), (None, 1.5, None), (None, None, "x")]
    blocks = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: E.format_action(F.lit("wait"), F.create_map().cast("map<string,string>"), F.lit("")))
    assert one(spark, E.format_actions(blocks))[0].count("<ACT:wait>") == 5
    assert len(E.special_tokens()) == 40


def test_vectors_and_codebooks(spark):
    df = spark.createDataFrame([(i, [math.sin(i * k + k) for k in range(1, 9)]) for i in range(60)], "id bigint, vec array<double>").cache()
    book = Q.learn_codebook(df, 3, 4, steps=3, seed=1)
    sql, arrow = (sorted((r["id"], r["codes"]) for r in Q.assign(df, book, engine=e).collect()) for e in ("sql", "arrow"))
    assert sql == arrow and all(len(c) == 3 and all(0 <= x < 4 for x in c) for _, c in sql)
    assert Q.learn_codebook(df, 1, 4, steps=2, rule="ema").count() == 4
    mean, axes = Q.principal_axes(df, 8)
    assert len(mean) == 8 and abs(sum(x * y for x, y in zip(*axes, strict=True))) < 1e-9
    v = F.array(F.lit(3.0), F.lit(4.0))
    q = F.array(F.lit(0.0), F.lit(2.0))
    got = one(spark, V.norm(v), V.rotation_trick(v, q), V.softmax(v), V.gumbel_softmax(v, F.lit(1)), V.warmup_cosine(F.lit(5), 10, 100), V.warmup_cosine(F.lit(100), 10, 100, 0.1))
    assert got[0] == 5 and got[1] == pytest.approx([0, 2], abs=1e-6) and sum(got[2]) == pytest.approx(1) and sum(got[3]) == pytest.approx(1) and got[4] == 0.5 and got[5] == pytest.approx(0.1)
    with pytest.raises(Exception, match="out of range"):
        Q.dense_matrix(df.select("id", F.lit("a").alias("v"), F.lit(1).alias("o")), 3, "id", "v", "o", "").collect()


@pytest.mark.parametrize("close", [False, True])
def test_chunks_keep_their_rule(spark, sf_dir, close):
    """Whatever way chunks are made: they join to the text, end at line ends, and each boundary is where the rule puts it."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", "\n\n", "a" * 90, "x\n" * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    head, most = "" if close else "# p\n", 60
    for r in df.select("i", T.chunk_lines(F.col("t"), most, F.lit(head), close).alias("c")).collect():
        text = texts[r["i"]]
        assert all(c.startswith(head) for c in r["c"] or [])
        bodies = [c[len(head) :] for c in r["c"] or []]
        assert "".join(bodies) == (text or "") and all(b and b.endswith("\n") for b in bodies[:-1])
        for body, behind in zip(bodies, bodies[1:], strict=False):
            if close:
                assert len(body) >= most and len(body[: body.rfind("\n", 0, -1) + 1]) < most
            else:
                next_line = behind[: behind.find("\n") + 1] or behind
                assert len(head + body + next_line) > most
        for body in bodies if not close else ():
            assert len(head + body) <= most or body.count("\n", 0, -1) == 0


def test_axes_of_wide_and_shifted_vectors(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(0, 1, (300, 40)) * np.linspace(3, 0.1, 40) + 1e6
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(-1, None), (-2, [1.0])], "id bigint, vec array<double>").repartition(6)
    mean, axes = Q.principal_axes(df, 40, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(np.asarray(axes) @ vectors[:, ::-1][:, :3]), np.eye(3), atol=1e-6)


def test_seeds_from_all_items(spark):
    """Far groups each get a seed, whatever their size; equal items are repeated."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, (np.array([100.0 * (i % 6 if i > 1900 else 0), 0]) + rng.normal(0, 0.1, 2)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)
    seeds = Q.kmeans_parallel(df, 6, 1)
    assert sorted(round(s[0] / 100) for s in seeds) == list(range(6)) and seeds == Q.kmeans_parallel(df, 6, 1)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id bigint, vec array<double>")
    assert Q.kmeans_parallel(same, 3) == [[1.0, 2.0]] * 3
    book = Q.learn_codebook(df, 2, 6, steps=2, normalize=False, seeds_of=Q.kmeans_parallel)
    assert book.count() == 12


def test_plugged_in_parts(spark, tmp_path):
    """Encoders, pooling, update rules and distances that are functions."""
    from semid.operators.encoding import encoded

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "id bigint, text string")
    got = {r["id"]: r["vec"] for r in encoded(df, "text", lambda: lambda ts: [[len(t), 1.0] for t in ts], normalize=False, at_once=2).collect()}
    assert got == {1: [2, 1], 2: [0, 1], 3: [4, 1]} and len(encoded(df, "text", width=8).first()["vec"]) == 8
    with pytest.raises(Exception, match="3 texts"):
        encoded(df.coalesce(1), "text", lambda: lambda ts: [[1.0]]).collect()
    rows = spark.createDataFrame([(1, 0, [1.0, 5.0]), (1, 1, [3.0, 2.0])], "k int, p int, v array<double>")
    assert Q2.pooled(rows, "k", "p", "v", 2, how=F.max).first()["pooled"] == [3, 5]
    items = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "id bigint, vec array<double>")
    book = Q.learn_codebook(items, 1, 2, steps=3, normalize=False, rule=lambda left, cs, kept: [[c[0] + 1, c[1]] for c in cs])
    assert sorted(r["vec"][0] for r in book.collect()) == [3.0, 4.0]
    fresh = Q.reseeded(items, [[9.0, 9.0], [8.0, 8.0], [7.0, 7.0]], [5.0, 0.0, 0.5], 1.0)
    assert fresh[0] == [9.0, 9.0] and all(v in ([0.0, 0.0], [1.0, 0.0]) for v in fresh[1:]) and Q.reseeded(None, [[9.0]], [5.0], 1.0) == [[9.0]]
    events = spark.createDataFrame([(1, 3), (2, 77)], "e int, id bigint")
    assert Q2.map_to_embeddings(events, items, "id", "id", "vec", "drop").count() == 1 and Q2.map_to_embeddings(events, items, "id", "id", "vec", "null").where("vec is null").count() == 1
    with pytest.raises(Exception, match="no vector for item 77"):
        Q2.map_to_embeddings(events, items, "id", "id", "vec").collect()
    (tmp_path / "x.txt").write_text("12345")
    assert files.exists(spark, str(tmp_path / "x.txt")) and not files.exists(spark, str(tmp_path / "y")) and files.size_of(spark, str(tmp_path)) >= 5


def test_ngrams_by_brute_force(spark, sf_dir):
    from collections import Counter

    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("one",)], "text string")
    runs = Counter()
    for r in df.select(T.pieces(F.col("text")).alias("p")).collect():
        p = r["p"] or []
        runs.update(tuple(p[i : i + n]) for n in (2, 3) for i in range(len(p) - n + 1))
    frequent = {g: c for g, c in runs.items() if c >= 25}
    shown = spark.createDataFrame([(list(g), c) for g, c in frequent.items()], "g array<string>, c bigint").select("c", F.size("g").alias("n"), T.surface(F.col("g")).alias("s")).collect()
    best = {}
    for r in shown:
        if len(r["s"]) >= 3 and not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", r["s"]):
            best[r["s"]] = max(best.get(r["s"], (0, 0)), (r["c"], r["n"]))
    assert {r["token"]: (r["frequency"], r["current_subtokens"]) for r in T.mine_ngrams(df).collect()} == best


def test_sequences(spark):
    s = F.col("s")
    df = spark.createDataFrame([([5, 0, 7, 9],)], "s array<bigint>")
    got = df.select(Q2.pad_or_trim(s, 6, -1), Q2.pad_or_trim(s, 2), Q2.remove_token(s, 0), Q2.with_separators(s, 2, -7), Q2.mask_with_separators(F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)), 2), Q2.level_offsets(F.array(*map(F.lit, [0, 1, 2, 5, 6, 7])), 3, 300)).first()
    assert list(got) == [[5, 0, 7, 9, -1, -1], [7, 9], [5, 7, 9], [5, 0, -7, 7, 9, -7], [1, 1, 1, 1, 0, 0], [0, 301, 602, 5, 306, 607]]
    assert Q2.contiguous_subsequences(df, "s").count() == 6
    with pytest.raises(Exception, match="too short"):
        df.select(Q2.next_k_labels(s, 4, -1)).collect()
    with pytest.raises(Exception, match="no codes for item"):
        Q2.map_to_codes(df.withColumn("u", F.lit(1)), spark.createDataFrame([(5, [1])], "item_id bigint, codes array<int>"), "u", "s").collect()


def test_metrics_for_one_positive(spark):
    ranked = spark.createDataFrame([(1, r, int(r == 3)) for r in range(1, 11)] + [(2, r, 0) for r in range(1, 11)], "query_id int, rank int, relevant int")
    got = {(r["query_id"], r["k"]): (r["recall"], r["ndcg"]) for r in R.ranking_metrics(ranked, [2, 5]).collect()}
    assert got[1, 2] == (0, 0) and got[1, 5] == (1, pytest.approx(1 / math.log2(4))) and got[2, 5] == (0, 0)


def test_file_assignment():
    sizes = [("a", 10), ("b", 7), ("c", 5), ("d", 4)]
    assert S.assign_files(sizes, 2) == [["a", "d"], ["b", "c"]] and S.assign_files(sizes, 2, "turn") == [["a", "c"], ["b", "d"]]


def test_files_and_sinks(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "node_modules/b.py": "y", "sub/c.go": "z", "d.txt": "no"}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\xfa")
    rows = files.source_files(spark, str(tmp_path / "src")).collect()
    assert {(r["rel_path"], r["language"], r["text"]) for r in rows} == {("a.py", "python", "x = 1"), ("sub/c.go", "go", "z")}
    assert files.list_files(spark, str(tmp_path / "src"), "*.py").count() == 2
    assert {r["folder"] for r in files.subfolders(spark, str(tmp_path / "src")).collect()} == {"node_modules", "sub"}
    steps = spark.createDataFrame([("e1", 1, 2.5), ("e1", 0, 1.0)], "episode_id string, step int, total double").select("episode_id", "step", F.create_map(F.lit("total"), F.col("total")).alias("reward"))
    sinks.write_episodes(steps, str(tmp_path / "out" / "e" / "episode.json"))
    back = spark.read.schema(E.EPISODE).json(str(tmp_path / "out" / "e" / "episode.json"))
    assert back.select(F.aggregate("steps", F.lit(0.0), lambda a, s: a + F.coalesce(s["reward"]["total"], F.lit(0.0)))).first()[0] == 3.5
    sinks.write_splits(spark.createDataFrame([("a", "train"), ("b", "eval")], "t string, split string"), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=eval").is_dir()
    pairs = spark.createDataFrame([([1, 2], ["a", "b"])], "k array<int>, p array<string>")
    assert [tuple(r) for r in sinks.prediction_rows(pairs, "k", "p").collect()] == [(1, "a"), (2, "b")]


def test_tfrecord_source(spark, tmp_path):
    import gzip

    rows = [{"user": [7], "items": [1, -2, 3], "score": [0.5, 1.5], "name": ["ab"]}, {"user": [8], "items": []}]
    assert decode_example(encode_example(rows[0])) == {"user": [7], "items": [1, -2, 3], "score": [0.5, 1.5], "name": [b"ab"]}
    with gzip.open(tmp_path / "a.tfrecord.gz", "wb") as f:
        f.write(b"".join(frame(encode_example(r)) for r in rows))
    spark.dataSource.register(TFRecordSource)
    got = spark.read.format("tfrecord").schema("user bigint, items array<bigint>, score array<float>, name string").load(str(tmp_path / "*.gz")).orderBy("user").collect()
    assert tuple(got[0]) == (7, [1, -2, 3], [0.5, 1.5], "ab") and got[1]["items"] == [] and got[1]["name"] is None
