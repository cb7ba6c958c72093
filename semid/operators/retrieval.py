"""Rankings, prefix-constrained beam search, Recall@K and NDCG@K."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semid.functions.vectors import dot, unit
from semid.session import scratch


def _packed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(ids, vecs, width) of up to ``most`` rows (id, vec) each: vectors as one run of doubles."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.asarray(part.column("vec").to_pylist(), dtype=float).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["ids", "vecs", "width"])

    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "ids array<bigint>, vecs binary, width int")


def _best(query_ids, q, key_ids, x, k: int) -> list:
    """Query ids, key ids and scores of each query's ``k`` best keys, as columns. Sums run in the order of the dimensions, so that equal keys tie."""
    import numpy as np

    scores = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        scores += q[:, d, None] * x[None, :, d]
    best = [np.lexsort((key_ids, -s))[:k] for s in scores]
    return [np.repeat(query_ids, [len(o) for o in best]), np.concatenate([key_ids[o] for o in best]), np.concatenate([s[o] for s, o in zip(scores, best, strict=True)])]


def top_k_by_dot(queries: DataFrame, keys: DataFrame, k: int, query_block: int = 256, key_block: int = 4096) -> DataFrame:
    """(query_id, key_id, score, rank): each query's ``k`` best keys by dot product, ties by the lower key.

    ``queries`` (query_id, vec) is a stated set; ``keys`` is (key_id, vec). Both are packed
    into blocks; a pair of blocks gives the ``k`` best of its keys for each of its queries,
    so neither all scores nor all queries are ever rows, or in one task, at once. Sums run
    in the order of the dimensions, so that equal keys tie.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for qi, qv, ki, kv, width in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vecs", "ids", "vecs", "width")), strict=True):
                columns = _best(np.asarray(qi), np.frombuffer(qv).reshape(-1, width), np.asarray(ki), np.frombuffer(kv).reshape(-1, width), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "key_id", "score"])

    q = _packed(queries, "query_id", query_block).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    best = q.crossJoin(_packed(keys, "key_id", key_block)).mapInArrow(run, "query_id bigint, key_id bigint, score double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id"))).where(F.col("rank") <= k)


def _celled(rows: DataFrame, id_col: str, cells: list[list[float]]) -> DataFrame:
    """(id, vec, cell): each vector's nearest of the ``cells``; null vectors are left out."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        centres = np.asarray(cells)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell, pa.int32())], ["id", "vec", "cell"])

    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    return named.mapInArrow(run, "id bigint, vec array<double>, cell int")


BLOCK = "cell int, part int, block string, ids array<bigint>, vecs binary, width int, centre array<double>, radius double, norm double"


def _cell_blocks(rows: DataFrame, id_col: str, cells: list[list[float]], most: int) -> DataFrame:
    """Blocks of up to ``most`` vectors of one cell, with their mean, the largest distance from it and the mean's norm; a table in the shared folder. A cell of many vectors is packed in as many parts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def packed(at: tuple[int, int], number: int, ids: list, vecs: list) -> pa.RecordBatch:
            x = np.stack(vecs)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
            row = [at[0], at[1], f"{at[0]}-{at[1]}-{number}", ids, x.tobytes(), x.shape[1], centre.tolist(), radius, float(np.linalg.norm(centre))]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        now, number, ids, vecs = None, 0, [], []
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, (id_, cell, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "cell", "part")), strict=True)):
                if ids and ((cell, part) != now or len(ids) == most):
                    yield packed(now, number, ids, vecs)
                    number, ids, vecs = (number + 1 if (cell, part) == now else 0), [], []
                now = (cell, part)
                ids.append(id_)
                vecs.append(x[i])
        if ids:
            yield packed(now, number, ids, vecs)

    spark, path = rows.sparkSession, scratch(rows.sparkSession, "cells")
    _celled(rows, id_col, cells).write.parquet(path)
    celled = spark.read.schema("id bigint, vec array<double>, cell int").parquet(path)
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each cell
    blocks, path = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").select("id", "vec", "cell", "part").mapInArrow(run, BLOCK), scratch(spark, "blocks")
    blocks.write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


class Pruned(NamedTuple):
    top: DataFrame  # query_id, key_id, score, rank
    blocks: DataFrame  # one row: pairs of blocks in all, and those that were skipped unread


def top_k_pruned(queries: DataFrame, keys: DataFrame, k: int, cells: list[list[float]], query_block: int = 256, key_block: int = 4096, probes: int = 1) -> Pruned:
    """As ``top_k_by_dot``, but key blocks that can't hold any of a query block's ``k`` best keys are skipped.

    Queries and keys are packed by their nearest of ``cells`` (any vectors will do, close
    ones prune best). Each query first meets ``probes`` parts of its own cell; its k-th best
    score there is a bound that its final k-th best can't be below. By Cauchy-Schwarz no
    key x of a block with mean c and radius r scores above q.c + |q| r; with the query
    block's own mean and radius that gives a bound for the pair of blocks, which Spark
    tests when it joins them, and the single queries' bounds leave out queries of the
    pairs that remain. Blocks whose bound equals a score are read, so ties come out as
    they do in the full scan. Nothing is left out without a bound.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for block, qi, qv, low, ki, kv, width, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("q_block", "q_ids", "q_vecs", "low", "ids", "vecs", "width", "centre", "radius")), strict=True):
                q, x, qi = np.frombuffer(qv).reshape(-1, width), np.frombuffer(kv).reshape(-1, width), np.asarray(qi)
                if low:
                    lowest, norms = dict(low), np.linalg.norm(q, axis=1)
                    most = q @ np.asarray(centre) + norms * radius + 1e-9 * norms * (np.linalg.norm(centre) + radius)
                    may = most >= np.asarray([lowest.get(i, -np.inf) for i in qi.tolist()])
                    q, qi = q[may], qi[may]
                if not len(q):
                    continue
                ids, found, scores = _best(qi, q, np.asarray(ki), x, k)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores)], ["q_block", "query_id", "key_id", "score"])

    out = "q_block string, query_id bigint, key_id bigint, score double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    first = lambda x: x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    q = _cell_blocks(queries, "query_id", cells, query_block).select(*[F.col(c).alias(f"q_{c}") for c in ("cell", "block", "ids", "vecs", "centre", "radius", "norm")])
    x = _cell_blocks(keys, "key_id", cells, key_block)
    own = (F.col("q_cell") == F.col("cell")) & (F.col("part") < probes)
    probed, path = q.withColumn("low", F.lit(None).cast("map<bigint,double>")).join(x, own).mapInArrow(run, out), scratch(queries.sparkSession, "probed")
    probed.write.parquet(path)
    probed = queries.sparkSession.read.schema(out).parquet(path)
    lows = first(probed).groupBy("q_block", "query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k)
    lows = lows.groupBy(F.col("q_block")).agg(F.map_from_entries(F.collect_list(F.struct("query_id", "low"))).alias("low"), F.min("low").alias("lowest"))  # a query block's ids at most
    q = q.join(lows, "q_block", "left").withColumn("lowest", F.when(F.size("low") == F.size("q_ids"), F.col("lowest")))
    reach = (F.col("q_norm") + F.col("q_radius")) * (F.col("norm") + F.col("radius"))
    most = dot(F.col("q_centre"), F.col("centre")) + F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius") + F.col("q_radius") * F.col("radius") + 1e-9 * reach
    met = ~own & (F.col("lowest").isNull() | (most >= F.col("lowest")))
    rest = q.join(x, met).mapInArrow(run, out)
    shape = ["q_cell", "q_block", "q_centre", "q_radius", "q_norm", "lowest"]
    pairs = q.select(*shape).crossJoin(x.select("cell", "part", "centre", "radius", "norm"))
    blocks = pairs.agg(F.count("*").alias("pairs"), F.count_if(~own & ~met).alias("skipped"))
    return Pruned(first(probed.unionByName(rest)).drop("q_block"), blocks)


def full_cross_entropy(queries: DataFrame, keys: DataFrame, normalize: bool = True, query_block: int = 256, key_block: int = 4096) -> DataFrame:
    """(query_id, loss): the cross entropy of each query's ``label`` against all keys by dot product; a query whose label has no key gives no row.

    ``queries`` is (query_id, label, vec), a stated set, and ``keys`` (key_id, vec). A pair of
    blocks gives a query's largest score and the sum of exponentials below it; these are combined.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for qi, qv, kv, width in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vecs", "vecs", "width")), strict=True):
                scores = np.frombuffer(qv).reshape(-1, width) @ np.frombuffer(kv).reshape(-1, width).T
                top = scores.max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(top), pa.array(np.exp(scores - top[:, None]).sum(axis=1))], ["query_id", "top", "total"])

    vec = F.col("vec").cast("array<double>")
    queries, keys = (x.withColumn("vec", unit(vec) if normalize else vec) for x in (queries, keys))
    q = _packed(queries, "query_id", query_block).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    parts = q.crossJoin(_packed(keys, "key_id", key_block)).mapInArrow(run, "query_id bigint, top double, total double")
    parts = parts.withColumn("most", F.max("top").over(Window.partitionBy("query_id")))
    sums = parts.groupBy("query_id").agg(F.max("most").alias("most"), F.sum(F.col("total") * F.exp(F.col("top") - F.col("most"))).alias("total"))
    wanted = queries.select("query_id", F.col("label").alias("key_id"), F.col("vec").alias("qv")).join(keys.select("key_id", F.col("vec").alias("kv")), "key_id")
    return sums.join(wanted, "query_id").select("query_id", (F.ln("total") + F.col("most") - dot(F.col("qv"), F.col("kv"))).alias("loss"))


def prefixes(codes: DataFrame, h: int, codes_col: str = "codes") -> DataFrame:
    """The distinct first ``h`` digits of all items."""
    return codes.select(F.slice(codes_col, 1, h).alias("prefix")).distinct()


def valid_prefixes(candidates: DataFrame, codes: DataFrame, h: int, col: str = "prefix") -> DataFrame:
    """Candidates whose prefix some item has."""
    return candidates.join(prefixes(codes, h).withColumnRenamed("prefix", col), col, "left_semi")


def transition_table(codes: DataFrame, levels: int, codes_col: str = "codes") -> DataFrame:
    """(level, prefix, code, prob): how often each digit follows a prefix among the items. It stands in for a neural scorer; any table of this form does."""
    every = None
    for h in range(levels):
        rows = codes.select(F.lit(h).alias("level"), F.slice(codes_col, 1, h).alias("prefix"), F.get(codes_col, F.lit(h)).alias("code")).groupBy("level", "prefix", "code").agg(F.count("*").alias("n"))
        every = rows if every is None else every.unionByName(rows)
    return every.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("level", "prefix"))).drop("n")


def beam_search(users: DataFrame, scores: DataFrame, levels: int, width: int, valid: DataFrame | None = None) -> DataFrame:
    """(user_id, codes, prob, rank): at each level all beams are extended by the score table, masked to prefixes that items of ``valid`` have, and the ``width`` best stay; ties by the lower beam, then code.

    ``scores`` is (level, prefix, code, prob), with ``user_id`` too where scores are personal.
    """
    beams = users.select("user_id").distinct().withColumns({"codes": F.array().cast("array<int>"), "prob": F.lit(1.0), "rank": F.lit(1)})
    personal = "user_id" in scores.columns
    for h in range(levels):
        step = scores.where(F.col("level") == h).select(*(["user_id"] if personal else []), F.col("prefix").alias("codes"), "code", F.when(F.isnan("prob"), -1.0).otherwise(F.col("prob")).alias("p"))
        grown = beams.join(step, ["user_id", "codes"] if personal else "codes").select("user_id", "rank", "code", F.concat("codes", F.array("code")).alias("codes"), (F.col("prob") * F.col("p")).alias("prob"))
        if valid is not None:
            grown = valid_prefixes(grown, valid, h + 1, "codes")
        best = Window.partitionBy("user_id").orderBy(F.desc("prob"), "rank", "code")
        beams = grown.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= width).select("user_id", "codes", "prob", F.col("_n").alias("rank"))
    return beams


def ranked_hits(predictions: DataFrame, labels: DataFrame, codes_col: str = "codes") -> DataFrame:
    """Predictions (user_id, codes, rank) with ``relevant``: 1 where all digits equal a label's."""
    wanted = labels.select("user_id", codes_col).distinct().withColumn("relevant", F.lit(1))
    return predictions.join(wanted, ["user_id", codes_col], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


#: Metrics by name: each from a query's sums at k (hits, all relevant, both gains, the first relevant rank, k).
METRICS: dict[str, Callable[[], Column]] = {
    "recall": lambda: F.col("hits") / F.greatest(F.lit(1), F.least("all", "k")),
    "ndcg": lambda: F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0),
    "precision": lambda: F.col("hits") / F.col("k"),
    "hit": lambda: (F.col("hits") > 0).cast("double"),
    "mrr": lambda: F.coalesce(1 / F.col("first"), F.lit(0.0)),
}


def ranking_metrics(ranked: DataFrame, ks: list[int], query: str = "query_id", metrics: tuple[str, ...] = ("recall", "ndcg")) -> DataFrame:
    """(query, k and a column for each of ``METRICS`` named) for every k. ``ranked`` is (query, rank, relevant); ideal orders and totals come from the candidate list itself, and a query without a relevant candidate scores 0."""
    ideal = Window.partitionBy(query).orderBy(F.desc("relevant"), "rank")
    x = ranked.withColumn("ideal", F.row_number().over(ideal)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    within = F.col("rank") <= F.col("k")
    gain = lambda at: F.sum(F.when(F.col(at) <= F.col("k"), F.col("relevant") / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    first = F.min(F.when(within & (F.col("relevant") > 0), F.col("rank")))
    sums = x.groupBy(query, "k").agg(F.sum(F.when(within, F.col("relevant")).otherwise(0)).alias("hits"), F.sum("relevant").alias("all"), gain("rank").alias("dcg"), gain("ideal").alias("idcg"), first.alias("first"))
    return sums.select(query, "k", *[METRICS[m]().alias(m) for m in metrics])


def mean_metrics(per_query: DataFrame, metrics: tuple[str, ...] = ("recall", "ndcg")) -> DataFrame:
    """(name, value), named as metric@k, over all queries."""
    long = per_query.select("k", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.groupBy(F.concat_ws("@", "metric", F.col("k").cast("string")).alias("name")).agg(F.avg("value").alias("value"))


def hash_draw(*parts: Column) -> Column:
    """48 bits of md5 of the parts: draws that any engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")


def sampled_negatives(queries: DataFrame, n: int, vocabulary: int, lowest: int = 0, seed: int = 0) -> DataFrame:
    """(query_id, j, key_id): the query's positive at j = 0 and ``n`` draws of ids from ``lowest`` to vocabulary - 1; draws may collide."""
    drawn = lowest + F.pmod(hash_draw(F.col("query_id"), F.col("j"), F.lit(seed)), F.lit(vocabulary - lowest))
    return queries.select("query_id", "positive", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("j")).select("query_id", "j", F.when(F.col("j") == 0, F.col("positive").cast("bigint")).otherwise(drawn).alias("key_id"))
