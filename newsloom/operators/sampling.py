"""Seeded sampling that gives the same rows on every engine and cluster."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import written

MAX_SAMPLE = 1_000_000


def dense_numbers(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `row_no` from 0 in the global order of `order`, by counts per range partition."""
    ranged = written(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    part = F.shiftright("_rid", 33).cast("int")
    sizes = dict((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    start = F.get(F.array(*(F.lit(x).cast("long") for x in starts or [0])), part)
    return ranged.withColumn("row_no", start + F.col("_rid").bitwiseAND(2**33 - 1)).drop("_rid")


def seeded_sample(numbered: DataFrame, n_rows: int, size: int, seed: int = 42) -> DataFrame:
    """Rows drawn without replacement, with `draw` (their place in the sample): the draw of a list of `n_rows` by a seeded generator; all rows if there are no more than `size`."""
    if size > MAX_SAMPLE:
        raise ValueError(f"more than {MAX_SAMPLE} draws")
    picks = list(range(n_rows)) if n_rows <= size else random.Random(seed).sample(range(n_rows), size)
    spark = numbered.sparkSession
    return numbered.join(F.broadcast(spark.createDataFrame(list(enumerate(picks)), "draw long, row_no long")), "row_no")


def hash_sample(df: DataFrame, key: Column, size: int, seed: int = 42) -> DataFrame:
    """`size` rows in the order of a hash of `key`."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


def two_stage_sample(df: DataFrame, fit: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows of `df` whose `key` is in `fit`, out of a hash-chosen pool half as large again: what doesn't fit is looked for in the pool only. With `draw`."""
    pool = hash_sample(df, F.col(key), -(-size * 3 // 2), seed)
    left = dense_numbers(pool.join(fit.select(key), key, "left_semi"), key)
    return seeded_sample(left, left.count(), size, seed)
