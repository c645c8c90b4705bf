"""The N best items of every group, with a fixed order, also for groups of millions.

Hot-cold split: groups are counted exactly. Heavy groups (at least MIN_HEAVY rows,
so no window ever sorts more) are sorted by range over (group, score, item), which
cuts each of them into many range partitions; the range is the
salt: every (group, range) keeps its own N, and the survivors, at most N a range,
are placed at the end. Light groups go through one shuffle and an ordinary window.
Both results are united.

An item counts once, with its highest score. Null and NaN scores are ignored, and
so are rows with a null group or item. Equal scores are placed by item, ascending.
Repeated rows change nothing; fewer than N items give fewer rows; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.skew import HOT_SHARE, salted_lookup
from newsloom.session import shuffle_parts, written

MIN_HEAVY = 10_000
#: A list of heavy groups of up to so many bytes is broadcast; a longer one is met by a join in which the hottest groups are salted.
BROADCAST_BYTES = 8_000_000


def heavy_groups(df: DataFrame, group: str) -> DataFrame:
    """`group`, `n`: those with at least MIN_HEAVY rows, counted exactly."""
    counts = df.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return written(counts.where((F.col("n") >= MIN_HEAVY) & F.col("group").isNotNull()))


def _marked(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """`rows` with `n`, null in light groups."""
    size, total = heavy.agg(F.sum(F.length(F.col("group").cast("string")) + 24), F.sum("n")).first()
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(heavy), "group", "left")
    share = HOT_SHARE * total
    hot = heavy.where(F.col("n") >= share).orderBy(F.desc("n"), "group").collect()  # at most 1 / HOT_SHARE
    return salted_lookup(rows, heavy, "group", "left", hot=[(r["group"], r["n"] / total) for r in hot])


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("item")]


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """`group`, `place` (1 to n), `item`, `score`."""
    parts = shuffle_parts(df.sparkSession)
    heavy = heavy_groups(df, group)
    rows = df.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).alias("score"))
    rows = rows.where("group is not null and item is not null and score is not null and not isnan(score)")
    by_group = Window.partitionBy("group").orderBy(*_order())
    any_heavy = bool(heavy.take(1))
    marked = _marked(rows, heavy) if any_heavy else rows
    light = marked.where("n is null") if any_heavy else rows
    light = light.repartition(parts, "group").groupBy("group", "item").agg(F.max("score").alias("score"))
    light = light.withColumn("place", F.row_number().over(by_group)).where(F.col("place") <= n)
    if not any_heavy:
        return light.select("group", "place", "item", "score")

    best = marked.where("n is not null").groupBy("group", "item").agg(F.max("score").alias("score"))
    ranged = best.repartitionByRange(parts, F.col("group"), *_order()).withColumn("_salt", F.spark_partition_id())
    kept = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("group", "_salt").orderBy(*_order()))).where(F.col("_k") <= n)
    hot = kept.withColumn("place", F.row_number().over(by_group)).where(F.col("place") <= n)
    return light.select("group", "place", "item", "score").unionByName(hot.select("group", "place", "item", "score"))
