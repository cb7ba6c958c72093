"""Vector expressions over ``array<double>`` columns. Sums run in array order, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, from differences rather than the expanded form, so that nearest ties agree."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def unit(v: Column, eps: float = 1e-12) -> Column:
    """L2-normalised, with a floor for the norm (1e-12 and 1e-8 are in use)."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(unit(a, eps), unit(b, eps))


def vector_of(agg, vec: str, width: int) -> Column:
    """An element-wise aggregate (``F.avg``, ``F.sum``) of vectors of known width, without exploding them: one buffer a dimension."""
    return F.array(*[agg(F.get(F.col(vec), F.lit(i))) for i in range(width)])


def softmax(v: Column) -> Column:
    exps = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(exps, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """``ln(sum(exp)) - logit of the label``, with the maximum taken out first."""
    return let(F.array_max(logits), lambda m: F.ln(total(F.transform(logits, lambda x: F.exp(x - m)))) + m - F.get(logits, label))


def weighted_squared_error(x: Column, y: Column, weight: Column | float = 1.0) -> Column:
    """A row's part of the loss: summed over rows it is the batch's."""
    return weight * sqdist(x, y)


def quantization_loss(x: Column, q: Column, beta: float = 0.25) -> Column:
    """A row's squared error once for the code and ``beta`` times for the encoder; both have one value."""
    return (1 + beta) * sqdist(x, q)


def squeeze(v: Column) -> Column:
    """A list of lists without its dimension of size one: lists of one item each, or one list. Other shapes are an error."""
    fits = (F.size(v) == 1) | F.forall(v, lambda x: F.size(x) == 1)
    return F.when(fits, F.flatten(v)).otherwise(F.raise_error(F.lit("no dimension of size one")).cast("array<double>"))


def rotation_trick(x: Column, q: Column, eps: float = 1e-6) -> Column:
    """``x`` rotated and rescaled onto ``q``: the value equals ``q``; the closed form is |q|/|x| * (x - 2 w (w.x) + 2 q^ (x^.x))."""

    def run(ux: Column, uq: Column) -> Column:
        w = let(add(ux, uq), lambda s: unit(s, eps))
        proj = let(w, lambda u: let(dot(u, x), lambda d: F.transform(u, lambda y: 2 * y * d)))
        back = let(dot(ux, x), lambda d: F.transform(uq, lambda y: 2 * y * d))
        return scale(add(subtract(x, proj), back), norm(q) / F.greatest(norm(x), F.lit(eps)))

    return let(unit(x, eps), lambda ux: let(unit(q, eps), lambda uq: run(ux, uq)))


def gumbel_softmax(logits: Column, key: Column, tau: float = 1.0) -> Column:
    """Softmax of logits with Gumbel noise drawn from a hash of ``key`` and the place."""

    def noise(i: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
        return -F.ln(-F.ln(u))

    return let(F.transform(logits, lambda x, i: (x + noise(i)) / tau), softmax)


def warmup_cosine(step: Column, warmup: int, total_steps: int, floor: float = 0.0) -> Column:
    """A learning-rate factor: linear up to 1, then a half cosine down to ``floor``."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total_steps - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(floor), 0.5 * (1 + F.cos(F.pi() * done))))
