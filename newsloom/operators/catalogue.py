"""The cleaned base tables: one row per article, labelled impressions, candidates, clicks, article vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.vectors import unit


def first_delivery(articles: DataFrame) -> DataFrame:
    """One row per article_id: the earliest delivered (then the least title)."""
    w = Window.partitionBy("article_id").orderBy("delivered_at", "title")
    return articles.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def impressions(behaviors: DataFrame) -> DataFrame:
    """Labelled impressions once each, with `split` from the id `{dataset}_{split}_{raw}`."""
    b = behaviors.where("clicked_article_ids is not null")
    return b.select("impression_id", "dataset", F.split("impression_id", "_")[1].alias("split"), "user_id", F.col("timestamp").alias("ts"), F.col("candidate_article_ids").alias("cands"), F.col("clicked_article_ids").alias("clicked"), "session_id", "read_time").distinct()


def candidates(imps: DataFrame) -> DataFrame:
    """One row per impression and place in its candidate list (0-based `pos`), `label` 1 for clicked; repeated candidates keep their places."""
    return imps.select("impression_id", "dataset", "split", "user_id", "ts", "clicked", F.posexplode("cands").alias("pos", "article_id")).withColumn("label", F.array_contains("clicked", F.col("article_id")).cast("int")).drop("clicked")


def clicks(click_log: DataFrame) -> DataFrame:
    """The click history without repeats: one row per (user, article, time); re-reads at another time stay. A repeat's greatest read time counts."""
    return click_log.where("user_id is not null and click_timestamp is not null").groupBy("user_id", "article_id", F.col("click_timestamp").alias("ts")).agg(F.max("read_time").alias("read_time"))


def article_vectors(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """`article_id`, unit `vec`. The test tables hold no article vectors: an article takes that of its id's digits."""
    n = embeddings.count()
    digits = F.regexp_replace("article_id", "[^0-9]", "").cast("long")
    a = articles.select("article_id", (digits % n).alias("vec_id"))
    v = embeddings.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("vec"))
    return a.join(v, "vec_id").select("article_id", "vec")
