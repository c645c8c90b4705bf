"""Point-in-time history: the most recent clicks of a user strictly before each impression.

Clicks and impressions are numbered together in time order by skew-safe prefix
sums, so each impression knows how many clicks of its user came before it. Clicks
are kept in blocks of N by their number; the N latest lie in at most two blocks,
each found by an equality join. No step holds a whole user in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.offset_chunks import prefix_sums

MAX_HISTORY = 20


def recent_history(events: DataFrame, clicks: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """`impression_id`, `user_id`, `ts`, `hist`: up to `n` clicks with a time strictly before `ts`, newest first (then article_id descending).

    Impressions of unknown or null users have an empty history.
    """
    nothing = F.lit(None).cast("string")
    c = clicks.select("user_id", "ts", F.lit(1).cast("long").alias("is_click"), "article_id", F.col("read_time").cast("double").alias("read_time"), nothing.alias("impression_id"))
    e = events.select("user_id", "ts", F.lit(0).cast("long").alias("is_click"), nothing.alias("article_id"), F.lit(None).cast("double").alias("read_time"), "impression_id")
    # At equal times impressions come first, so a click at the very time isn't seen.
    s = prefix_sums(c.unionByName(e), "user_id", ["ts", "is_click", "article_id"], "is_click")
    item = F.struct((F.col("before") + 1).alias("no"), "ts", "article_id", "read_time")
    blocks = s.where("is_click = 1").groupBy("user_id", F.floor(F.col("before") / n).alias("block")).agg(F.sort_array(F.collect_list(item), asc=False).alias("b"))
    asked = s.where("is_click = 0").select("impression_id", "user_id", "ts", "before", F.floor((F.col("before") - 1) / n).alias("block"))
    both = asked.join(blocks.withColumnRenamed("b", "b1"), ["user_id", "block"], "left").withColumn("block", F.col("block") - 1).join(blocks.withColumnRenamed("b", "b2"), ["user_id", "block"], "left")
    none = F.array().cast(blocks.schema["b"].dataType)
    seen = F.filter(F.concat(F.coalesce("b1", none), F.coalesce("b2", none)), lambda x: x["no"] <= F.col("before"))
    known = both.select("impression_id", "user_id", "ts", F.slice(seen, 1, n).alias("hist"))
    unknown = events.where("user_id is null").select("impression_id", "user_id", "ts", none.alias("hist"))
    return known.unionByName(unknown)


def exploded(history: DataFrame) -> DataFrame:
    """`impression_id`, `user_id`, `ts`, `h` (1 = newest), `article_id`, `click_ts`, `read_time`."""
    x = history.select("impression_id", "user_id", "ts", F.posexplode("hist").alias("h", "x"))
    return x.select("impression_id", "user_id", "ts", (F.col("h") + 1).alias("h"), "x.article_id", F.col("x.ts").alias("click_ts"), "x.read_time")


def leaks(history: DataFrame) -> DataFrame:
    """History entries at or after their impression's time: must be empty."""
    return exploded(history).where("click_ts >= ts")
