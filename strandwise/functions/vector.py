"""Column expressions for dense vectors; elements are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors, clipped to 0..2."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))


def unit(v: Column) -> Column:
    """Divided by the norm, but by no less than 1e-12."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def chunk_starts(n: Column, budget: int) -> Column:
    """Starts of token chunks; an empty text has one."""
    return F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(budget))
