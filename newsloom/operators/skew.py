"""Equality lookups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.session import shuffle_parts

#: Keys with at least this share of the rows are hot, or with half an average partition where there are more than 500 partitions.
HOT_SHARE = 0.001
#: Salts of a key that holds all rows, as a multiple of the number of partitions.
SPREAD = 8


def hot_keys(df: DataFrame, key: Column, share: float | None = None) -> list[tuple]:
    """(key, its share of all non-null rows), exactly, of the keys holding at least `share`: at most 1 / share of them."""
    share = share or min(HOT_SHARE, 0.5 / shuffle_parts(df.sparkSession))
    seen = Observation()
    counts = df.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "key").limit(round(1 / share)).collect()
    total = seen.get["total"] or 0
    return [(x["key"], x["n"] / total) for x in top if x["n"] >= share * total and x["n"] > 1]


def with_salts(df: DataFrame, key: str, hot: list[tuple], name: str) -> DataFrame:
    """`df` with an int column `name`: over how many salts a row's key is to be spread, 1 for a cold key, by its share for a hot one.

    All hot keys together get at most SPREAD times as many salts as there are partitions, and one more each: with fewer, chance would put too many of them into one task.
    """
    if not hot:
        return df.withColumn(name, F.lit(1))
    parts = shuffle_parts(df.sparkSession)
    schema = df.select(F.col(key)).schema.add(name, "integer")
    keys = df.sparkSession.createDataFrame([(k, ceil(SPREAD * parts * share) + 1) for k, share in hot], schema)
    return df.join(F.broadcast(keys), key, "left").withColumn(name, F.coalesce(name, F.lit(1)))  # a list of at most 1 / share keys


def salted_lookup(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """`facts` joined with `dim` on `key`. Hot keys' facts are spread over salts, and only their `dim` rows are repeated that often.

    Null keys match nothing (`left` keeps their facts); repeated `dim` rows multiply as in any join.
    """
    hot = hot_keys(facts, F.col(key)) if hot is None else hot
    if not hot:
        return facts.join(dim, key, how)
    f, d = salted_sides(facts, dim, key, hot)
    return f.join(d, [key, "__nl_salt"], how).drop("__nl_salt")


def salted_sides(facts: DataFrame, dim: DataFrame, key: str, hot: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The two sides of a lookup on `key`, with a column `__nl_salt` to join on as well (none where nothing is hot), for joins with further conditions."""
    if not hot:
        return facts, dim
    f = with_salts(facts, key, hot, "__nl_n").withColumn("__nl_salt", F.pmod(F.xxhash64(*facts.columns), F.col("__nl_n")).cast("int")).drop("__nl_n")
    d = with_salts(dim, key, hot, "__nl_n").withColumn("__nl_salt", F.explode(F.sequence(F.lit(0), F.col("__nl_n") - 1))).drop("__nl_n")
    return f, d
