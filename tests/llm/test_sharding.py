"""The hash ring against one that takes keys one after the other, and its laws."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from conftest import ODD  # noqa: F401

from semid.llm import sharding
from semid.llm.queries import QUERIES
from semid.llm.sharding import POINTS, bounds, fill, owner, places, ring, shard_rows


def key_of(i):
    d = md5(("null" if i is None else f"key {i}").encode()).hexdigest()
    return int(d[:8], 16) % POINTS, int(d[8:23], 16)


def walk(ids, shards, virtual):
    """{id: shard}: keys settle one by one. First every key asks its own node; those that found it full then go clockwise together, node by node."""
    nodes = ring(shards, virtual)
    room = bounds(len(ids), shards)
    at = defaultdict(list)
    for i in sorted(ids, key=key_of):
        at[next((k for k, (p, _) in enumerate(nodes) if p >= key_of(i)[0]), 0)].append(i)
    out, full = {}, defaultdict(list)
    for k, (_, s) in enumerate(nodes):
        # points behind the last node belong to the first one, and come behind its own
        for i in sorted(at[k], key=key_of):
            if room[s]:
                room[s] -= 1
                out[i] = s
            else:
                full[k].append(i)
    queue = []
    for step in range(2 * len(nodes)):
        k = step % len(nodes)
        while queue and room[nodes[k][1]]:
            out[queue.pop(0)] = nodes[k][1]
            room[nodes[k][1]] -= 1
        if step == k:
            queue += full[k]
    return out


def test_query_keeps_the_law(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = QUERIES["op11_hash_ring"](spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40))
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize(("n", "shards", "virtual"), [(3000, 7, 16), (500, 40, 3), (5, 8, 4), (1, 1, 1)])
def test_equals_keys_taken_one_by_one(spark, n, shards, virtual):
    df = spark.createDataFrame([(i, "x") for i in range(n)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["shard"] for r in shard_rows(df, shards, virtual=virtual).collect()}
    assert got == walk(range(n), shards, virtual)


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "'x' text")
    a = {r["doc_id"]: r["shard"] for r in shard_rows(df, 10).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_rows(df, 11).collect()}
    moved = sum(a[i] != b[i] for i in a)
    assert moved < 2.5 * len(a) / 11  # the new shard's share, and what overflows elsewhere


def test_law_of_the_key(spark):
    df = spark.range(5000).selectExpr("id doc_id", "'x' text")
    rows = shard_rows(df, 9, law="key").collect()
    less = {r["doc_id"]: r["shard"] for r in shard_rows(df.where("doc_id % 3 = 0"), 9, law="key").collect()}
    more = {r["doc_id"]: r["shard"] for r in shard_rows(df, 10, law="key").collect()}
    assert all(r["shard"] == less.get(r["doc_id"], r["shard"]) and r["grown_shard"] == more[r["doc_id"]] for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 9) for r in rows) and any(r["grown_shard"] == 9 for r in rows)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(9))
    with pytest.raises(ValueError):
        shard_rows(df, 9, law="other")


def test_a_key_with_most_rows_is_spread(spark):
    rows = [(None, "n")] * 700 + [(1, "a")] * 500 + [(i, "b") for i in range(2, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    got = shard_rows(df, 13, virtual=8).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 5


def test_odd_rows(odd, none):
    got = shard_rows(odd, 4, carry=("salt", "rank")).collect()
    assert len(got) == len(ODD) and all(r["salt"] == 3 and r["rank"] == 11 for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16}
    assert shard_rows(none, 4).count() == 0


def test_plans_hold_bounds(monkeypatch):
    monkeypatch.setattr(sharding, "POINTS", 64)
    for shards, virtual in ((3, 4), (5, 2), (8, 2)):
        nodes = ring(shards, virtual)
        loads = [(7 * k * k) % 23 for k in range(len(nodes))]
        plan = fill(loads, [s for _, s in nodes], bounds(sum(loads), shards))
        assert [sum(n for _, n in p) for p in plan] == loads
        spread = places(plan, shards)
        held = Counter()
        for _, lo, hi, s, first in spread:
            assert first == held[s]
            held[s] += hi - lo
        assert [held[s] for s in range(shards)] == bounds(sum(loads), shards)
        assert all(nodes[owner(nodes, p)][0] >= p or p > nodes[-1][0] for p in range(64))
    with pytest.raises(ValueError):
        ring(30, 4)
