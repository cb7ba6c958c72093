"""Vectors to short hierarchical codes: nearest centroids, residual levels, codebook learning.

Codebooks have K vectors a level, a number fixed by the configuration and small
enough for every task (L * K * d numbers); they travel as one literal array, so
assignment is a projection of the items, without a join or a row for each pair.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semid.functions.vectors import sqdist, subtract, unit, vector_of
from semid.operators.sampling import placed, ranked
from semid.session import stored


def codebook_rows(codebook: DataFrame) -> list[list[list[float]]]:
    """``codebook`` (level, code, vec) as vectors by level and code."""
    levels: dict[int, dict[int, list[float]]] = {}
    for r in codebook.select("level", "code", "vec").collect():
        levels.setdefault(r["level"], {})[r["code"]] = list(r["vec"])
    return [[levels[k][c] for c in sorted(levels[k])] for k in sorted(levels)]


def centroids_column(centroids: list[list[float]]) -> Column:
    """All centroids as one literal: JSON keeps every digit, and Spark reads it once when it plans."""
    return F.from_json(F.lit(json.dumps([[float(x) for x in c] for c in centroids])), "array<array<double>>")


def nearest(vec: Column, centroids: Column, distance: Callable[[Column, Column], Column] = sqdist) -> Column:
    """A struct (dist, code) of the centroid nearest by ``distance``; the lowest code wins ties."""
    return F.array_min(F.transform(centroids, lambda c, i: F.struct(distance(vec, c).alias("dist"), i.alias("code"))))


def assign(items: DataFrame, codebook: DataFrame, vec_col: str = "vec", normalize: bool = True, engine: str = "sql", distance: Callable[[Column, Column], Column] = sqdist) -> DataFrame:
    """Adds ``codes`` (array<int>), ``residual`` and ``quantized`` by the residual loop: at each level normalise what is left (if asked), take the nearest centroid, subtract it.

    ``engine='sql'`` evaluates expressions; ``'arrow'`` multiplies matrices in batches,
    for wide vectors and large codebooks, by squared distances only.
    """
    levels = codebook_rows(codebook)
    if engine == "arrow":
        return _assign_arrow(items, levels, vec_col, normalize)
    out = items.withColumn("residual", F.col(vec_col).cast("array<double>")).withColumn("codes", F.array().cast("array<int>")).withColumn("quantized", F.transform("residual", lambda x: F.lit(0.0)))
    for level in levels:
        out = out.withColumn("_r", unit(F.col("residual")) if normalize else F.col("residual"))
        out = out.withColumn("_c", nearest(F.col("_r"), centroids_column(level), distance)["code"])
        out = out.withColumn("_v", F.get(centroids_column(level), F.col("_c")))
        out = out.withColumns({"residual": subtract(F.col("_r"), F.col("_v")), "codes": F.concat("codes", F.array("_c")), "quantized": F.zip_with("quantized", "_v", lambda x, y: x + y)})
    return out.drop("_r", "_c", "_v")


def _assign_arrow(items: DataFrame, levels: list, vec_col: str, normalize: bool) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        books = [np.asarray(x) for x in levels]
        for batch in batches:
            r = np.asarray(batch.column(vec_col).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            codes, quantized = [], np.zeros_like(r)
            for book in books:
                if normalize:
                    r = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
                code = np.argmin((r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1), axis=1)
                codes.append(code)
                r, quantized = r - book[code], quantized + book[code]
            more = [pa.array(r.tolist(), pa.list_(pa.float64())), pa.array(np.stack(codes, 1).tolist(), pa.list_(pa.int32())), pa.array(quantized.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "residual", "codes", "quantized"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, kind + ", residual array<double>, codes array<int>, quantized array<double>")


def collision_digit(items: DataFrame, codes_col: str = "codes", order_col: str = "id") -> DataFrame:
    """Adds ``digit``: 0 where the codes are unique, else 1, 2, ... by ``order_col``."""
    out = ranked(items, codes_col, [order_col], "_rank")
    return out.withColumn("digit", F.when(F.col("_rank_n") > 1, F.col("_rank").cast("int")).otherwise(0)).drop("_rank", "_rank_n")


def level_codes(assigned: DataFrame, codes_col: str = "codes") -> DataFrame:
    """(level, code) for each digit of each item, levels from 1."""
    return assigned.select(F.posexplode(codes_col).alias("level", "code")).withColumn("level", F.col("level") + 1)


def code_counts(assigned: DataFrame, codes_col: str = "codes") -> DataFrame:
    return level_codes(assigned, codes_col).groupBy("level", "code").agg(F.count("*").alias("n"))


def coverage_entropy(assigned: DataFrame, size: int, codes_col: str = "codes") -> DataFrame:
    """Per level: codes in use, their share of ``size``, and the entropy (natural logarithm) of their frequencies."""
    p = code_counts(assigned, codes_col).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("level")))
    return p.groupBy("level").agg(F.count("*").alias("used"), (F.count("*") / F.lit(float(size))).alias("coverage"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def unique_fraction(assigned: DataFrame, codes_col: str = "codes") -> DataFrame:
    """Distinct tuples, rows, and their ratio, by two aggregates (no distinct set in one task)."""
    return assigned.groupBy(codes_col).agg(F.count("*").alias("n")).agg(F.count("*").alias("tuples"), F.sum("n").alias("items")).withColumn("fraction", F.col("tuples") / F.col("items"))


def norm_ratio(assigned: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Frobenius ratios of what is left and of what was quantized to the input, and the mean squared error."""
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    v = F.col(vec_col).cast("array<double>")
    sums = assigned.agg(F.sum(sq(v)).alias("x"), F.sum(sq(F.col("residual"))).alias("r"), F.sum(sq(F.col("quantized"))).alias("q"), F.avg(sqdist(v, F.col("quantized")) / F.size(v)).alias("mse"))
    return sums.select(F.sqrt(F.col("r") / F.col("x")).alias("residual_ratio"), F.sqrt(F.col("q") / F.col("x")).alias("quantized_ratio"), "mse")


def cluster_sums(items: DataFrame, centroids: list[list[float]], vec_col: str = "vec") -> DataFrame:
    """(code, n, total): counts and vector sums of the items nearest to each centroid, one buffer a dimension and combined before the shuffle."""
    width = len(centroids[0])
    coded = items.select(F.col(vec_col).cast("array<double>").alias("v")).withColumn("code", nearest(F.col("v"), centroids_column(centroids))["code"])
    return coded.groupBy("code").agg(F.count("*").alias("n"), vector_of(F.sum, "v", width).alias("total"))


def minibatch_step(batch: DataFrame, centroids: list[list[float]], counts: list[float], vec_col: str = "vec") -> tuple[list[list[float]], list[float]]:
    """One mini-batch k-means update: each centroid moves towards its batch mean by the batch's share of all items it has had."""
    new, seen = [list(c) for c in centroids], list(counts)
    for r in cluster_sums(batch, centroids, vec_col).collect():  # K rows
        k, n = r["code"], r["n"]
        seen[k] += n
        new[k] = [c + (t / n - c) * n / seen[k] for c, t in zip(new[k], r["total"], strict=True)]
    return new, seen


def ema_step(batch: DataFrame, centroids: list[list[float]], sizes: list[float], sums: list[list[float]], decay: float = 0.99, eps: float = 1e-5, vec_col: str = "vec") -> tuple[list[list[float]], list[float], list[list[float]]]:
    """One moving-average update with Laplace smoothing of the cluster sizes: new centroids, sizes and sums."""
    got = {r["code"]: r for r in cluster_sums(batch, centroids, vec_col).collect()}
    k, width = len(centroids), len(centroids[0])
    sizes = [decay * s + (1 - decay) * (got[i]["n"] if i in got else 0) for i, s in enumerate(sizes)]
    sums = [[decay * a + (1 - decay) * b for a, b in zip(sums[i], got[i]["total"] if i in got else [0.0] * width, strict=True)] for i in range(k)]
    n = sum(sizes)
    smooth = [(s + eps) / (n + k * eps) * n for s in sizes]
    return [[x / max(s, eps) for x in row] for row, s in zip(sums, smooth, strict=True)], sizes, sums


def kmeans_plus_plus(items: DataFrame, k: int, seed: int = 0, vec_col: str = "vec", id_col: str = "id", buffer: int = 3072) -> list[list[float]]:
    """Seeds from a buffer of at most ``buffer`` items in hash order: the first at random, each next with probability proportional to its least squared distance, uniform once all are 0."""
    import numpy as np

    rows = items.select(F.col(vec_col).cast("array<double>").alias("v"), F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))).alias("h")).orderBy("h").limit(buffer).collect()
    x, rng = np.asarray([r["v"] for r in rows]), np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = np.full(len(x), np.inf)
    while len(chosen) < k:
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x))))
    return x[chosen].tolist()


def _squares(items: DataFrame, centres: list[list[float]], vec_col: str, id_col: str) -> DataFrame:
    """(id, vec, code, d): the nearest of ``centres`` and the squared distance to it, in matrix products a batch."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = np.asarray(centres)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            code = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(code, pa.int32()), pa.array(((x - c[code]) ** 2).sum(1) if batch.num_rows else [], pa.float64())], ["id", "vec", "code", "d"])

    rows = items.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, vec array<double>, code int, d double")


def kmeans_parallel(items: DataFrame, k: int, seed: int = 0, vec_col: str = "vec", id_col: str = "id", rounds: int = 5, factor: float = 2.0) -> list[list[float]]:
    """Seeds from all items (k-means||): in each round every item is drawn with a chance of ``factor`` * k times its share of the squared distances to the seeds so far.

    Draws are hashes of id and round. The items nearest to each of the drawn seeds, about
    ``factor`` * k * ``rounds`` and the first, are counted, and weighted k-means++ on the
    driver, whose input depends on these three numbers alone, reduces them to ``k``. Items
    of no distance are never drawn; fewer different items than ``k`` are repeated.
    """
    import numpy as np

    draw = lambda r: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(f"{seed}|{r}"))), 1, 12), 16, 10).cast("double") / 16.0**12
    centres = random_seeds(items, 1, seed, vec_col, id_col)
    for r in range(rounds):
        far = _squares(items, centres, vec_col, id_col)
        cost = far.agg(F.sum("d")).first()[0]
        if not cost:
            break
        drawn = far.where(draw(r) < F.lit(factor * k) * F.col("d") / F.lit(float(cost))).select("vec", "id").orderBy("id").collect()  # about factor * k
        centres += [list(x["vec"]) for x in drawn]
    held = {x["code"]: x["count"] for x in _squares(items, centres, vec_col, id_col).groupBy("code").count().collect()}
    x, w, rng = np.asarray(centres), np.asarray([float(held.get(i, 0)) for i in range(len(centres))]), np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        p = w * d
        chosen.append(int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else chosen[len(chosen) % len(set(chosen))])
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].tolist()


def random_seeds(items: DataFrame, k: int, seed: int = 0, vec_col: str = "vec", id_col: str = "id") -> list[list[float]]:
    """``k`` items in hash order, repeated from the start if there are fewer."""
    rows = items.orderBy(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))).limit(k).select(F.col(vec_col).cast("array<double>").alias("v")).collect()
    return [list(rows[i % len(rows)]["v"]) for i in range(k)]


def reseeded(items: DataFrame, centroids: list[list[float]], sizes: list[float], least: float, seed: int = 0, vec_col: str = "vec", id_col: str = "id") -> list[list[float]]:
    """The centroids, those of fewer than ``least`` items replaced by items in hash order; without any such the items are not read."""
    dead = [i for i, n in enumerate(sizes) if n < least]
    fresh = dict(zip(dead, random_seeds(items, len(dead), seed, vec_col, id_col), strict=True)) if dead else {}
    return [fresh.get(i, c) for i, c in enumerate(centroids)]


def learn_codebook(items: DataFrame, levels: int, size: int, steps: int = 10, seed: int = 0, normalize: bool = True, vec_col: str = "vec", id_col: str = "id", tolerance: float = 0.0, rule: str | Callable[[DataFrame, list, dict], list] = "minibatch", seeds_of: Callable[..., list[list[float]]] = kmeans_plus_plus) -> DataFrame:
    """Residual k-means, one level after the other: seed (by ``kmeans_plus_plus``, ``random_seeds`` or a function like them), update ``steps`` times (or until no centroid moves more than ``tolerance``), then quantize what is left. Returns (level, code, vec).

    ``rule`` is "minibatch", "ema" or a function of the items, the centroids and a dictionary
    that it may keep things in from step to step, which gives the next centroids. What each level has to quantize is a table in the shared folder, read in each of its steps.
    """
    spark = items.sparkSession
    left = items.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = []
    for level in range(levels):
        if normalize:
            left = left.withColumn("vec", unit(F.col("vec")))
        left = stored(left, "residuals")
        centroids = seeds_of(left, size, seed + level, "vec", "id")
        counts, sizes, sums = [0.0] * size, [0.0] * size, [[0.0] * len(centroids[0]) for _ in range(size)]
        kept: dict = {}
        for _ in range(steps):
            before = centroids
            if callable(rule):
                centroids = rule(left, centroids, kept)
            elif rule == "ema":
                centroids, sizes, sums = ema_step(left, centroids, sizes, sums)
                centroids = reseeded(left, centroids, sizes, 1e-12, seed + level + 1)
            else:
                centroids, counts = minibatch_step(left, centroids, counts)
            if max(abs(a - b) for x, y in zip(before, centroids, strict=True) for a, b in zip(x, y, strict=True)) <= tolerance:
                break
        rows += [(level, code, list(c)) for code, c in enumerate(centroids)]
        book = centroids_column(centroids)
        left = left.withColumn("vec", subtract(F.col("vec"), F.get(book, nearest(F.col("vec"), book)["code"])))
    return spark.createDataFrame(rows, "level int, code int, vec array<double>")


def dead_codes(assigned: DataFrame, spark: SparkSession, levels: int, size: int) -> DataFrame:
    """(level, code) that no item has."""
    every = spark.range(levels * size).select((F.floor(F.col("id") / size) + 1).cast("int").alias("level"), (F.col("id") % size).cast("int").alias("code"))
    return every.join(level_codes(assigned).distinct(), ["level", "code"], "left_anti")


def codebook_usage(counts: DataFrame, size: int, eps: float = 1e-5) -> DataFrame:
    """Per level, the share of ``size`` codes whose (moving average) count exceeds ``eps``; ``counts`` has (level, code, n)."""
    return counts.where(F.col("n") > eps).groupBy("level").agg((F.count("*") / F.lit(float(size))).alias("usage"))


def dense_matrix(rows: DataFrame, n: int, id_col: str, value_col: str, order_col: str, fill) -> DataFrame:
    """One row for each id from 0 to n - 1: the latest value by ``order_col``, or ``fill``. An id of n or more is an error."""
    checked = rows.withColumn(id_col, F.when(F.col(id_col) < n, F.col(id_col)).otherwise(F.raise_error(F.concat(F.lit("id out of range: "), F.col(id_col).cast("string"))).cast("long")))
    last = checked.groupBy(id_col).agg(F.max_by(value_col, order_col).alias(value_col))
    return rows.sparkSession.range(n).withColumnRenamed("id", id_col).join(last, id_col, "left").withColumn(value_col, F.coalesce(value_col, F.lit(fill)))


def transpose(assigned: DataFrame, id_col: str = "id", codes_col: str = "codes", block: int = 10_000) -> DataFrame:
    """(level, block, first, codes): the codes of each level, from 1, as rows over the items in the order of their ids, cut into blocks of ``block`` items of which ``first`` is the first id."""
    order = placed(assigned.select(F.col(id_col).alias("_id"), F.col(codes_col).alias("_codes")), ["_id"], "_place")
    long = order.select("_id", "_place", F.floor((F.col("_place") - 1) / block).alias("block"), F.posexplode("_codes").alias("_at", "_code"))
    whole = long.groupBy((F.col("_at") + 1).alias("level"), "block").agg(F.sort_array(F.collect_list(F.struct("_place", "_id", "_code"))).alias("_rows"))  # block items
    return whole.select("level", "block", F.get("_rows", F.lit(0))["_id"].alias("first"), F.transform("_rows", lambda r: r["_code"]).alias("codes"))


def project_rows(vectors: list[list[float]], width: int, target_norm: float, seed: int = 0) -> list[list[float]]:
    """Codebook rows by a seeded random projection, scaled to one norm."""
    import numpy as np

    x = np.asarray(vectors, dtype=float)
    out = x @ np.random.default_rng(seed).standard_normal((x.shape[1], width)) / np.sqrt(width)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) * target_norm).tolist()


def principal_axes(items: DataFrame, width: int, axes: int = 2, vec_col: str = "vec") -> tuple[list[float], list[list[float]]]:
    """Mean and leading axes of the vectors of ``width`` numbers.

    A task adds up its vectors and their outer products about the first vector of all (one
    matrix product a batch), and the tasks' sums, width * width numbers each, are merged as a tree.
    """
    import numpy as np
    import pyarrow as pa

    rows = items.select(F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") == width)
    first = rows.first()
    if first is None:
        raise ValueError("no vectors of this width")
    about = np.asarray(first["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - about
            n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], total, products.ravel()]).tobytes()], pa.binary())], ["sums"])

    sums = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"])).treeReduce(np.add)
    n, mean, products = sums[0], sums[1 : width + 1] / sums[0], sums[width + 1 :].reshape(width, width)
    values, vectors = np.linalg.eigh(products / n - np.outer(mean, mean))
    return (mean + about).tolist(), vectors[:, np.argsort(values)[::-1][:axes]].T.tolist()
