"""Near duplicates and the pipeline against brute force."""

import random

import pytest
from conftest import ODD  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from semid.llm import near_dedup as N
from semid.llm.near_dedup import near_dedup, near_groups


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*[w[i:] for i in range(k)], strict=False))


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (a == b or 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(map(repr, out))


def _got(df):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in df.collect())


@pytest.mark.parametrize("k", [2, 5])
def test_groups_by_brute_force(spark, sf_dir, k):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(i and i + 1000, t) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _got(near_groups(df, words=k)) == brute(rows, k)


def test_chains_copies_and_unlike_hubs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = rng.sample(words, 120)
    rows, n = [], 0
    for _ in range(60):  # copies of one text, not all alike each other
        t = list(base)
        for p in rng.sample(range(120), rng.choice([2, 5, 8])):
            t[p] = rng.choice(words)
        rows.append((n := n + 1, " ".join(t)))
    t = rng.sample(words, 100)
    for i in range(25):  # a chain: each like the one before
        t = t[:]
        t[4 * i % 100] = rng.choice(words)
        t[(4 * i + 50) % 100] = rng.choice(words)
        rows.append((n := n + 1, " ".join(t)))
    rows += [(n + i, " ".join(rng.sample(words, 80))) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _got(near_groups(df, words=2)) == brute(rows, 2)


def test_blocks_find_what_stars_left(spark, monkeypatch):
    """With one turn of single stars and blocks of four nodes a side, most links come from the blocks."""
    monkeypatch.setattr(N, "WORTH", 0)
    monkeypatch.setattr(N, "HUBS", 1)
    monkeypatch.setattr(N, "SIDE", 4)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(6):
        base = rng.sample(words, 60)
        for i in range(8):
            t = list(base)
            for p in rng.sample(range(60), 3):
                t[p] = rng.choice(words)
            rows.append((g * 10 + i, " ".join(t)))
    assert _got(near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2)) == brute(rows, 2)


@pytest.mark.parametrize("side", [16, 4096])
def test_divided_large_buckets_are_settled_whole(spark, monkeypatch, side):
    """At the production bands and rows: template texts that are unlike each hub but alike in pairs, by rare words or by common ones alone."""
    monkeypatch.setattr(N, "SIDE", side)
    monkeypatch.setattr(N, "HUBS", 1)
    rng = random.Random(11)
    fresh = (f"u{i}" for i in range(10**6))
    rows = []
    for g in range(3):
        template = [f"t{g}w{i}" for i in range(100)]
        for i in range(40):  # 14 to 20 own words: not alike
            rows.append([*template, *(next(fresh) for _ in range(rng.randint(14, 20)))])
            if i % 4 == 0:  # near copies of it
                rows.append([*rows[-1][:-3], *(next(fresh) for _ in range(3))])
        for cut in range(0, 90, 10):  # variants of the template: alike by common words alone, within a variant and with the next one
            rows += [[*template[:cut], *template[cut + 10 :], *(next(fresh) for _ in range(n))] for n in (3, 9, 10, 11, 18, 19)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    for k in (1, 2):
        assert _got(near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=k)) == brute(rows, k)


def test_pairs_in_very_large_buckets(spark):
    """1,600 texts in 800 pairs: all share a passage of 60 %, the rest are common words, so buckets hold hundreds of nodes that are not alike."""
    rng = random.Random(17)
    shared, common = [f"s{i}" for i in range(120)], [f"c{i}" for i in range(400)]
    rows = []
    for i in range(800):
        own = rng.choices(common, k=80)
        other = list(own)
        for p in rng.sample(range(80), 3):
            other[p] = rng.choice(common)
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    assert _got(near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2)) == brute(rows, 2)


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 4, 5, 40, 900, 5000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2), dtype=np.uint64)]))
            apart = sum(int(x).bit_count() for x in (N.parity_bits(a) ^ N.parity_bits(b)).view(np.uint64))
            assert apart <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 30, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((N.sketch(a, 960) == N.sketch(b, 960)).mean() - true) < 0.25
        assert (N.sketch(a, 192) != 0).all()


def test_dedup_keeps_the_least(spark, odd, none):
    kept = near_dedup(odd, words=2)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] in (4, 5, 7, 8)) == [4, 7] and set(kept.columns) == set(odd.columns)
    assert near_groups(none).count() == near_dedup(none).count() == 0


def test_dedup_tells_texts_of_one_id_apart(spark):
    """Ids that repeat name several texts: rows go by id and text, and of equal rows one stays; rows without words all stay."""
    a, x = "a b c d e f g h", "x y z u v w r s"
    df = spark.createDataFrame([(1, a), (1, x), (0, x), (2, a), (2, a), (1, a), (3, None), (3, None), (4, " ")], "doc_id bigint, text string")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in near_dedup(df, words=2).collect()))) == sorted(map(repr, [(1, a), (0, x), (3, None), (3, None), (4, " ")]))


def test_pipeline_stages_keep_columns_and_do_their_work(spark, tmp_path):
    """On a small corpus whose right result is known: junk, common lines, a near copy and a secret."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    good = [text(60) for _ in range(40)]
    rows = [(i, t + "\n Shared LINE of all \n" + text(30)) for i, t in enumerate(good)]
    rows[1] = (1, rows[1][1] + ' token = "abcdefgh12345678"')
    rows.append((100, rows[0][1] + " tail"))
    junk = [(200 + i, " ".join(w + "***" for w in rng.choices(words, k=50))) for i in range(20)]
    rows += junk + [(300, "too short"), (301, None), (302, "a b c d e " * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows if i != 302], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["quality"]) == {i for i, _ in rows if i < 200}
    assert all("shared" not in r["text"].lower() and r["n_chars"] == len(r["text"]) for r in seen["lines"].values())
    assert set(seen["near duplicates"]) == set(range(40))
    assert "[secret]" in seen["secrets"][1]["text"] and "abcdefgh12345678" not in seen["secrets"][1]["text"] and seen["secrets"][2]["text"] == seen["lines"][2]["text"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(40)) and len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_pipeline_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
