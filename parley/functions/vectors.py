"""Vector functions as column expressions over ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision, summed in order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector at length one; a zero vector has none."""
    a = F.col(a) if isinstance(a, str) else a
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def finite(a: str | Column) -> Column:
    """Whether every component is a finite number."""
    a = F.col(a) if isinstance(a, str) else a
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_mean(values: str | Column, k: int = 3) -> Column:
    """Mean of the k largest values, or of all if there are fewer."""
    values = F.col(values) if isinstance(values, str) else values
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda t, x: t + x) / F.size(top)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded; what comes to nothing keeps its sign (-0.0), as in DuckDB."""
    return F.when(F.round(x, digits) == 0, x * F.lit(0.0)).otherwise(F.round(x, digits))
