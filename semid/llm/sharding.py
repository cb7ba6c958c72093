"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many points of a ring, its virtual nodes; a key belongs to the
first node at or behind its own point. A shard has a bound: its own keys fill it up to
there, and the keys beyond go on clockwise to the first shard that has room left, where
they queue behind those that have come further. Bounds that add up to all rows give counts
at most one apart, and only keys that overflow depend on other keys.

How many keys each arc (the points that belong to a node) sends where is planned on the
driver from one count for each arc, whatever the number of rows. Rows then take the
places of their arc's plan by their rank in it. Ranks are sums of counts: of points
before theirs in the arc, of keys before theirs at the point, and of a row's place among
those of its key in the task that read it, so that no key, however often it is repeated, is ranked
in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole, written

#: Points of the ring.
POINTS = 1 << 17


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(point, shard) of all nodes, by point. Of nodes that meet at a point the one of the least hash stays, whatever the number of shards."""
    if shards * virtual > POINTS // 4:
        raise ValueError("too many nodes for the points of the ring: take fewer virtual nodes a shard")
    best: dict[int, tuple[str, int]] = {}
    for shard in range(shards):
        for v in range(virtual):
            digest = md5(f"shard {shard} node {v}".encode()).hexdigest()
            point = int(digest[:8], 16) % POINTS
            best[point] = min(best.get(point, ("g", 0)), (digest, shard))
    return sorted((point, shard) for point, (_, shard) in best.items())


def owner(nodes: list[tuple[int, int]], point: int) -> int:
    """The arc of a point: the place of its node."""
    return bisect_left(nodes, (point, -1)) % len(nodes)


def bounds(rows: int, shards: int) -> list[int]:
    """Rows for each shard, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(loads: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) that its keys go to, in order. ``room`` adds up to ``loads`` or more."""
    left, plan, over = list(room), [], []
    for load, shard in zip(loads, owners, strict=True):
        kept = min(load, left[shard])
        left[shard] -= kept
        plan.append([(shard, kept)] if kept else [])
        over.append(load - kept)
    waiting: deque[tuple[int, int]] = deque()
    for step in range(2 * len(loads)):  # the second turn serves those that came too late for the first nodes
        at = step % len(loads)
        while waiting and left[owners[at]]:
            arc, n = waiting.popleft()
            taken = min(n, left[owners[at]])
            left[owners[at]] -= taken
            plan[arc].append((owners[at], taken))
            if taken < n:
                waiting.appendleft((arc, n - taken))
        if step == at and over[at]:
            waiting.append((at, over[at]))
    return plan


def places(plan: list[list[tuple[int, int]]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, lowest rank, next rank, shard, slot of the lowest rank)."""
    used, out = [0] * shards, []
    for arc, parts in enumerate(plan):
        lo = 0
        for shard, n in parts:
            out.append((arc, lo, lo + n, shard, used[shard]))
            used[shard] += n
            lo += n
    return out


def arcs(spark: SparkSession, nodes: list[tuple[int, int]], name: str) -> DataFrame:
    """(point, ``name``) for every point of the ring."""
    spans = [(0 if i == 0 else nodes[i - 1][0] + 1, p, i) for i, (p, _) in enumerate(nodes)]
    if nodes[-1][0] < POINTS - 1:
        spans.append((nodes[-1][0] + 1, POINTS - 1, 0))
    spread = spark.createDataFrame(spans, f"lo long, hi long, {name} int")
    return spread.select(F.explode(F.sequence("lo", "hi")).alias("point"), name)


def hashed(id_col: Column) -> tuple[Column, Column]:
    """A key's point and 60 further bits; a null key has its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("key "), id_col.cast("string")), F.lit("null")))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return F.pmod(number(1, 8), F.lit(POINTS)), number(9, 15)


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", virtual: int = 256, law: str = "rows", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row its id, the ``carry`` columns, size, text_crc32, law, shard, slot and grown_shard.

    Law ``rows`` bounds the shards, so that their rows are at most one apart; law ``key``
    sets no bound, so that the id and the number of shards decide, and ``grown_shard`` is
    the shard under one more, which takes rows only into itself (null under ``rows``).
    Slots count a shard's rows from 0 without gaps. A null text is empty (size 16); null
    ids are one key; rows that repeat an id stand at one point of the ring and, where it
    overflows, spread over several shards; equal rows may change places; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    if law not in ("rows", "key"):
        raise ValueError("law is rows or key")
    spark, nodes, grown = docs.sparkSession, ring(shards, virtual), ring(shards + 1, virtual)
    point, rest = hashed(F.col(id_col))
    text = whole(text_col)
    names = list(dict.fromkeys((id_col, *carry)))
    rows = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("named"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), point.alias("point"), rest.alias("rest"), F.spark_partition_id().alias("task")
    ).join(F.broadcast(arcs(spark, nodes, "arc")), "point")  # a row for each point
    rows = written(rows, "ring")  # the number of the task that read a row stays as it is
    loads = dict(rows.groupBy("arc").count().collect())  # a row for each node at most
    total, owners = sum(loads.values()), [shard for _, shard in nodes]
    room = bounds(total, shards) if law == "rows" else [total] * shards
    plan = places(fill([loads.get(a, 0) for a in range(len(nodes))], owners, room), shards)

    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    points = rows.groupBy("arc", "point").agg(F.count("*").alias("n"))
    points = points.select("point", earlier("n", before("arc", ["point"])).alias("in_arc"))
    cells = rows.groupBy("point", "rest", "task").agg(F.count("*").alias("n"))
    cells = cells.select("point", "rest", "task", earlier("n", before("point", ["rest", "task"])).alias("at_point"))
    of_key = Window.partitionBy("point", "rest", "task").orderBy("crc", "size")
    ranked = rows.withColumn("in_cell", F.row_number().over(of_key) - 1).join(cells, ["point", "rest", "task"]).join(F.broadcast(points), "point")  # a row for each point
    ranked = ranked.withColumn("rank", F.col("in_arc") + F.col("at_point") + F.col("in_cell"))
    dealt = spark.createDataFrame(plan, "a int, lo long, hi long, shard int, first long")
    out = ranked.join(F.broadcast(dealt), (F.col("arc") == F.col("a")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    if law == "key":
        more = arcs(spark, grown, "node").join(F.broadcast(spark.createDataFrame([(i, s) for i, (_, s) in enumerate(grown)], "node int, grown int")), "node").select("point", "grown")
        out = out.join(F.broadcast(more), "point")
    else:
        out = out.withColumn("grown", F.lit(None).cast("int"))
    return out.select(
        *[F.col("named")[c].alias(c) for c in names], "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.col("grown").alias("grown_shard")
    )
