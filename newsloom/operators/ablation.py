"""Deliberate leaks, to measure what point-in-time correctness is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.skew import salted_lookup


def leaked_history(history: DataFrame, imps: DataFrame, articles: DataFrame) -> DataFrame:
    """`history` with the distinct articles appended that the user clicked in other impressions of `imps`, unless they are the impression's own answers or not in the catalogue.

    A user's clicked articles are one set, bounded by the catalogue. The result itself
    repeats it for each of the user's impressions, so it grows with the square of a
    user's clicks; what only needs vectors takes `leaked_user_vectors`.
    """
    known = imps.where("user_id is not null").select("user_id", F.explode("clicked").alias("article_id")).distinct().join(articles.select("article_id"), "article_id", "left_semi")
    per_user = known.groupBy("user_id").agg(F.collect_list("article_id").alias("all"))
    own = imps.select("impression_id", F.col("clicked").alias("own"))
    both = salted_lookup(history.join(own, "impression_id", "left"), per_user, "user_id", "left")
    none = F.array().cast("array<string>")
    extra = F.array_sort(F.array_except(F.coalesce("all", none), F.coalesce("own", none)))
    item = F.transform(extra, lambda a: F.struct(F.lit(0).cast("long").alias("no"), F.lit(None).cast("timestamp_ntz").alias("ts"), a.alias("article_id"), F.lit(None).cast("double").alias("read_time")))
    return both.select("impression_id", "user_id", "ts", F.concat("hist", item).alias("hist"))


def leaked_user_vectors(history: DataFrame, imps: DataFrame, articles: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """`impression_id`, `vec`: the mean vector of each leaked history, without building one.

    A user's distinct clicked articles are one sum of vectors; an impression takes
    that sum, less its own answers, plus its history. So the work is linear in clicks,
    and a row a user is all that is looked up.
    """
    v = vectors.join(articles.select("article_id"), "article_id", "left_semi")
    sums = [F.sum(F.col("w") * F.col("vec")[i]).alias(f"v{i}") for i in range(dims)]
    clicked = imps.where("user_id is not null").select("impression_id", "user_id", F.explode(F.array_distinct("clicked")).alias("article_id"))
    users = clicked.select("user_id", "article_id").distinct().withColumn("w", F.lit(1)).join(v, "article_id").groupBy("user_id").agg(F.sum("w").alias("w"), *sums)
    seen = history.select("impression_id", F.explode("hist.article_id").alias("article_id")).withColumn("w", F.lit(1)).join(vectors, "article_id")
    own = clicked.select("impression_id", "article_id").withColumn("w", F.lit(-1)).join(v, "article_id")
    local = seen.unionByName(own).groupBy("impression_id").agg(F.sum("w").alias("lw"), *(c.alias(f"l{i}") for i, c in enumerate(sums)))
    both = salted_lookup(history.select("impression_id", "user_id"), users, "user_id", "left").join(local, "impression_id", "left")
    n = F.coalesce("w", F.lit(0)) + F.coalesce("lw", F.lit(0))
    zero = F.lit(0.0)
    return both.where(n > 0).select("impression_id", F.array(*((F.coalesce(f"v{i}", zero) + F.coalesce(f"l{i}", zero)) / n for i in range(dims))).alias("vec"))
