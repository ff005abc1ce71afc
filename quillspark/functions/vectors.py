"""Vector arithmetic on ARRAY<FLOAT> columns, in double precision."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07  # of a 32-bit float


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """0 where lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def is_valid(a: Column, dims: Column | int) -> Column:
    dims = F.lit(dims) if isinstance(dims, int) else dims
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(a.isNotNull() & (F.size(a) == dims) & finite & (norm(a) * norm(a) > EPSILON), F.lit(False))


def normalise(a: Column, dims: Column | int) -> Column:
    """Unit length; null for vectors that cannot be used."""
    n = norm(a)
    return F.when(is_valid(a, dims), F.transform(a, lambda x: x.cast("double") / n))


def blend_best_two(scores: Column) -> Column:
    """0.8 best + 0.2 second best; a single score supports itself; 0 for none."""
    best = F.sort_array(scores, asc=False)
    return F.when(F.size(scores) > 0, 0.8 * F.get(best, F.lit(0)) + 0.2 * F.coalesce(F.get(best, F.lit(1)), F.get(best, F.lit(0)))).otherwise(0.0)


def mean_vector(vector: str, dims: int) -> Column:
    """Element-wise mean as an aggregate; ``dims`` plain averages, which combine map-side."""
    return F.array(*[F.avg(F.get(F.col(vector), F.lit(k)).cast("double")) for k in range(dims)])


def dot_unrolled(a: str, b: str, dims: int) -> Column:
    """Dot product as one generated expression; for known dimensions."""
    return functools.reduce(operator.add, [F.get(F.col(a), F.lit(k)).cast("double") * F.get(F.col(b), F.lit(k)).cast("double") for k in range(dims)])
