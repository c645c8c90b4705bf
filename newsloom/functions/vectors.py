"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """`v` over its length; the zero vector stays as it is."""
    # The length is bound by an outer lambda, else it would be computed again for each element.
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null or zero."""
    return F.coalesce(dot(unit(a), unit(b)), F.lit(0.0))


def mean_pool(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """`key` and the elementwise mean `vec`, as `dims` averages of one hash aggregation."""
    cols = df.select(key, *(F.col(vec)[i].alias(f"v{i}") for i in range(dims)))
    return cols.groupBy(key).agg(F.array(*(F.avg(f"v{i}") for i in range(dims))).alias(vec))
