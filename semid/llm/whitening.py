"""Whitening of embeddings by a two-pass covariance.

Entries become whole numbers, so the first pass adds them up exactly, in any order, and
their sums give the mean. The second pass takes the mean off each block of vectors,
multiplies the block with itself (one NumPy GEMM) and ``treeAggregate`` merges the
products, a width x width matrix for each task. LAPACK's symmetric ``eigh`` finds the
axes on the driver, whose work depends on the width alone; the scaled axes are broadcast
and project every vector. A last pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries beyond this are out of range; sums stay exact for 2**36 vectors.
MOST = 1 << 52
LOW = 26
#: Axes whose share of the largest variance is below this have none.
NO_VARIANCE = 1e-12


def blocks(column, width: int | None, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the vectors of each width in an Arrow list column, or of ``width`` only; vectors with null, non-finite or out-of-range entries are left out."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)  # nulls become nan
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for w in np.unique(lengths[lengths > 0]).tolist() if width is None else [width] if width else []:
        at = np.flatnonzero(lengths == w)
        if not len(at):
            continue
        x = flat.reshape(-1, w) if len(at) * w == len(flat) else flat[starts[at][:, None] + np.arange(w)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * x) + shift
            good = (np.abs(x) <= MOST).all(axis=1)  # false for nan and infinity
        yield at[good], x[good].astype(np.int64)


@dataclass(frozen=True)
class Whitener:
    """Mean and scaled axes of a fit list of ``n`` vectors."""

    n: int
    base: np.ndarray  # whole part of the mean
    rest: np.ndarray  # sums less n * base: below n
    axes: np.ndarray  # width x components, each over the root of its variance
    explained: list[float]
    scale: float
    shift: int

    @property
    def width(self) -> int:
        return len(self.base)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / max(self.n, 1)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum)**2 of each row; null where that is no 64-bit number."""
        about = np.square(self.n * self.centred(x)).sum(axis=1)
        far = about > 2.0**62
        with np.errstate(over="ignore"):
            out = np.square(self.n * (x - self.base) - self.rest).sum(axis=1).tolist()
        for i in np.flatnonzero(far).tolist():
            exact = sum((self.n * (a - b) - c) ** 2 for a, b, c in zip(x[i].tolist(), self.base.tolist(), self.rest.tolist(), strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out


def _rows(frame: DataFrame, vec_col: str) -> DataFrame:
    return frame.select(F.col(vec_col).cast("array<double>").alias("vec"))


def _sums(vectors: DataFrame, scale: float, shift: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By width: the number of vectors, and the sums of their entries' high and low bits."""
    import pyarrow as pa

    def add(a: dict, b: dict) -> dict:
        out = dict(a)
        for w, (n, high, low) in b.items():
            m, h, lo = out.get(w, (0, 0, 0))
            out[w] = (m + n, h + high, lo + low)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for _, x in blocks(batch.column("vec"), None, scale, shift):
                total = add(total, {x.shape[1]: (len(x), (x >> LOW).sum(axis=0), (x & ((1 << LOW) - 1)).sum(axis=0))})
        columns = [pa.array(list(total), pa.int32()), pa.array([n for n, _, _ in total.values()], pa.int64()), *[pa.array([v[k].tobytes() for v in total.values()], pa.binary()) for k in (1, 2)]]
        yield pa.RecordBatch.from_arrays(columns, ["w", "n", "high", "low"])

    parts = vectors.mapInArrow(count, "w int, n long, high binary, low binary").rdd
    one = lambda r: {r["w"]: (r["n"], np.frombuffer(r["high"], np.int64), np.frombuffer(r["low"], np.int64))}
    return parts.treeAggregate({}, lambda acc, r: add(acc, one(r)), add)


def _products(vectors: DataFrame, model: Whitener, project: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of outer products of the centred vectors, or of their projections."""
    import pyarrow as pa

    sent, size = vectors.sparkSession.sparkContext.broadcast(model), model.axes.shape[1] if project else model.width

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = sent.value, np.zeros((size + 1, size))
        for batch in batches:
            for _, x in blocks(batch.column("vec"), m.width, m.scale, m.shift):
                y = m.centred(x) @ m.axes if project else m.centred(x)
                total[:-1] += y.T @ y
                total[-1] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = vectors.mapInArrow(multiply, "v binary").rdd
    total = parts.treeAggregate(np.zeros((size + 1, size)), lambda acc, r: acc + np.frombuffer(r["v"]).reshape(size + 1, size), lambda a, b: a + b)
    return total[-1], total[:-1]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> Whitener:
    """The whitener of all vectors of the commonest width (the lesser one of a tie); see ``whiten``."""
    rows = _rows(vectors, vec_col)
    by_width = _sums(rows, scale, shift)
    if not by_width:
        return Whitener(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), [], scale, shift)
    width = min(by_width, key=lambda w: (-by_width[w][0], w))
    n, high, low = by_width[width]
    sums = [(int(h) << LOW) + int(lo) for h, lo in zip(high, low, strict=True)]
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    plain = Whitener(n, base, rest, np.eye(width), [], scale, shift)
    _, products = _products(rows, plain, project=False)
    values, axes = np.linalg.eigh((products + products.T) / (2 * n))
    order = [i for i in np.argsort(-values)[:components] if values[i] > NO_VARIANCE * max(values.max(), 0)]
    scaled = axes[:, order] / np.sqrt(values[order])
    return Whitener(n, base, rest, scaled, (values[order] / values.sum()).tolist() if order else [], scale, shift)


def identity_error(vectors: DataFrame, model: Whitener, vec_col: str = "embedding") -> float:
    """How far the covariance of all projections is from the identity, at its worst entry."""
    if not model.explained:
        return 0.0
    sums, products = _products(_rows(vectors, vec_col), model, project=True)
    mean = sums / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(vectors: DataFrame, model: Whitener, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per vector: its id, the ``carry`` columns, ``deviation`` and ``whitened``, an array of its projections by falling variance.

    Entries c are read as floor(scale * c) + shift. Left out are null and empty vectors,
    those with null or non-finite entries or entries beyond 2**52, and those of another
    width than the model's. Axes without variance (a share of the largest below 1e-12) are
    no components, so equal vectors give none. ``deviation`` is null where it is no 64-bit
    number. Null ids and repeated rows are rows like others, and count as often as they
    stand; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    import pyarrow as pa

    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at, x in blocks(batch.column("vec"), m.width, m.scale, m.shift):
                y = m.centred(x) @ m.axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("named").take(pa.array(at)), pa.array(m.deviations(x), pa.int64()), lists], ["named", "deviation", "whitened"])

    names = list(dict.fromkeys((id_col, *carry)))
    rows = vectors.select(F.struct(*[F.col(c) for c in names]).alias("named"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = rows.mapInArrow(project, f"named {dict(rows.dtypes)['named']}, deviation long, whitened array<double>")
    return out.select(*[F.col("named")[c].alias(c) for c in names], "deviation", "whitened")
