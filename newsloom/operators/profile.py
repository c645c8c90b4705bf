"""Profiles of a table: nulls, frequent values, numeric summaries, differences between schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_audit(df: DataFrame) -> DataFrame:
    """`column_name`, `nulls`, `n_rows`: one pass over the table."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))
    return counted.select("_n", F.explode(cells).alias("x")).select("x.column_name", "x.nulls", F.col("_n").alias("n_rows"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    return df.agg(F.count(c).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.countDistinct(c).alias("distinct_values"))


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns only in one of two tables, and those whose types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"only_a": sorted(x.keys() - y.keys()), "only_b": sorted(y.keys() - x.keys()), "types": sorted(c for c in x.keys() & y.keys() if x[c] != y[c])}


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """`column_name`, `n`, `mean`, `stddev`, `least`, `greatest` of numeric columns, in one pass."""
    stats = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "least": F.min, "greatest": F.max}
    row = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in stats.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}_{n}").alias(n) for n in stats)) for c in cols))))


def table_metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """`table_name`, `n_columns`, `n_rows`: schemas and counts, which read no column of a parquet table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
