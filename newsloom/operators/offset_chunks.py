"""Per-key results without imbalance, by exact offset chunking.

Rows are range-partitioned by their order columns plus a unique tie-breaker, so
partitions are equal in size whatever the keys look like. Keys are counted per
partition, the counts are prefix-summed into offsets, and each row gets its
exact number within its key. A key's rows fall into equal-sized chunks of that
numbering; each chunk gives a small state (count, first, last, breaks, sums), and
a key's states are merged in chunk order. No task ever sees more of one key than
one partition's share of it.

Defined results: rows with a null key are left out; a null order value sorts
first and opens no break; equal order values are numbered in input order;
repeated rows count as often as they occur; an empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import shuffle_parts, written

CHUNK_ROWS = 50_000


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """`df` (rows with a key) with `before`, the sum of `value` over the key's earlier rows in `order`, and its place `_part`, `_rid`."""
    parts = partitions or shuffle_parts(df.sparkSession)
    ranged = (
        df.where(F.col(key).isNotNull())
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    # The range bounds come from a sample, so the partitions are frozen before they are counted.
    frozen = written(ranged).withColumn("_part", F.shiftright("_rid", 33).cast("int"))
    counts = frozen.groupBy(key, "_part").agg(F.sum(value).alias("n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A key's offset in a range stands before its rows there, so one running sum over the range gives all; the rows of a range stay one task.
    offsets = counts.select(key, "_part", F.lit(-1).cast("long").alias("_rid"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(value))
    both = frozen.unionByName(offsets, allowMissingColumns=True).repartitionById(parts, F.col("_part"))
    local = Window.partitionBy(key, "_part").orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("before", F.sum(value).over(local)).where("_rid >= 0")


def number_rows(df: DataFrame, key: Column, order: Column, sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """`key`, `at` (the order value), `_part`, `_rid`, `row_no` (0-based within the key, in order) and a column per entry of `sums`."""
    rows = df.select(key.alias("key"), order.alias("at"), F.lit(1).cast("long").alias("_one"), *(c.alias(f"s_{n}") for n, c in (sums or {}).items()))
    return prefix_sums(rows, "key", ["at"], "_one", partitions).drop("_one").withColumnRenamed("before", "row_no")


def chunk_states(numbered: DataFrame, gap_seconds: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One boundary state for each (key, chunk, partition): rows, first and last order value, breaks within, sums."""
    chunked = numbered.withColumn("_chunk", F.floor(F.col("row_no") / chunk_rows))
    w = Window.partitionBy("key", "_part").orderBy("_rid")
    same = F.lag("_chunk").over(w) == F.col("_chunk")
    broke = (same & _gap(F.lag("at").over(w), F.col("at"), gap_seconds)).cast("long")
    sums = [c for c in numbered.columns if c.startswith("s_")]
    return (
        chunked.withColumn("_broke", F.coalesce(broke, F.lit(0)))
        .groupBy("key", "_chunk", "_part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("_broke").alias("breaks"), *(F.sum(c).alias(c) for c in sums))
    )


def merge_states(states: DataFrame, gap_seconds: int) -> DataFrame:
    """One row per key: `n_rows`, `first_at`, `last_at`, `n_runs` (stretches without a gap over `gap_seconds`) and the sums."""
    w = Window.partitionBy("key").orderBy("_chunk", "_part")
    joint = _gap(F.lag("last_at").over(w), F.col("first_at"), gap_seconds).cast("long")
    sums = [c for c in states.columns if c.startswith("s_")]
    return (
        states.withColumn("breaks", F.col("breaks") + F.coalesce(joint, F.lit(0)))
        .groupBy("key")
        .agg(F.sum("n").alias("n_rows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), (F.sum("breaks") + 1).alias("n_runs"), *(F.sum(c).alias(c[2:]) for c in sums))
    )


def per_key(df: DataFrame, key: Column, order: Column, sums: dict[str, Column] | None = None, gap_seconds: int = 1800, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Numbering, chunk states and their ordered merge in one call."""
    return merge_states(chunk_states(number_rows(df, key, order, sums), gap_seconds, chunk_rows), gap_seconds)


def heavy_keys(results: DataFrame, total: int, share: float) -> DataFrame:
    """Of `per_key` results, the keys that hold at least `share` of `total` rows."""
    return results.where(F.col("n_rows") >= F.lit(share * total - 1e-9))


def _gap(earlier: Column, later: Column, seconds: int) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) > seconds * 1_000_000
