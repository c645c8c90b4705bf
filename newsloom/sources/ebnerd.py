"""EB-NeRD: parquet files cleaned into the unified schemas."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import ARTICLES, BEHAVIORS, USER_HISTORY, assert_schema

#: Folder -> split.
SPLIT_DIRS = {"train": "train", "validation": "val", "test": "test"}


def clean_articles(raw: DataFrame) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return assert_schema(raw.select(
        s("article_id").alias("article_id"), F.lit("ebnerd").alias("dataset"), "title", F.col("subtitle").alias("abstract"), "body", s("category_str").alias("category"), F.array_join(F.col("subcategory").cast("array<string>"), ",").alias("subcategory"),
        F.col("published_time").cast("timestamp_ntz").alias("published_time"), F.array_join(F.col("ner_clusters").cast("array<string>"), "|").alias("entities"), F.col("sentiment_score").cast("float").alias("sentiment_score"),
        F.col("total_pageviews").cast("long").alias("total_pageviews"), F.col("total_inviews").cast("long").alias("total_inviews"), F.lit(None).cast("array<float>").alias("embedding"),
    ), ARTICLES)


def clean_behaviors(raw: DataFrame, split: str) -> DataFrame:
    """Ids become strings; a table without the label column has null clicks."""
    clicked = F.col("article_ids_clicked").cast("array<string>") if "article_ids_clicked" in raw.columns else F.lit(None).cast("array<string>")
    raw_id = F.col("impression_id").cast("string")
    return assert_schema(raw.select(
        F.concat(F.lit(f"ebnerd_{split}_"), raw_id).alias("impression_id"), raw_id.alias("raw_impression_id"), F.col("user_id").cast("string").alias("user_id"), F.lit("ebnerd").alias("dataset"),
        F.col("impression_time").cast("timestamp_ntz").alias("timestamp"), F.col("article_ids_inview").cast("array<string>").alias("candidate_article_ids"), clicked.alias("clicked_article_ids"),
    ), BEHAVIORS)


def clean_user_history(raw: DataFrame) -> DataFrame:
    """One row per distinct (article, time) of each user's parallel lists, duplicates removed within the row before anything is exploded; re-reads at another time stay."""
    pairs = F.array_distinct(F.arrays_zip(F.col("article_id_fixed").alias("a"), F.col("impression_time_fixed").alias("t")))
    x = raw.select(F.col("user_id").cast("string").alias("user_id"), F.explode(pairs).alias("x"))
    return assert_schema(x.select("user_id", F.lit("ebnerd").alias("dataset"), F.col("x.a").cast("string").alias("article_id"), F.col("x.t").cast("timestamp_ntz").alias("click_timestamp")), USER_HISTORY)


def dwell(raw: DataFrame) -> DataFrame:
    """`user_id`, `article_id`, `click_timestamp`, `read_time`: of equal keys the last in the list that has a time."""
    x = raw.select(F.col("user_id").cast("string").alias("user_id"), F.posexplode(F.arrays_zip(F.col("article_id_fixed").alias("a"), F.col("impression_time_fixed").alias("t"), F.col("read_time_fixed").alias("r"))).alias("k", "x"))
    return x.groupBy("user_id", F.col("x.a").cast("string").alias("article_id"), F.col("x.t").cast("timestamp_ntz").alias("click_timestamp")).agg(F.max_by(F.col("x.r").cast("double"), F.when(F.col("x.r").isNotNull(), F.col("k"))).alias("read_time"))


def clean_ebnerd(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables under `root` (articles.parquet and a folder a split, each with behaviors and history)."""
    out = {"articles": clean_articles(spark.read.parquet(f"{root}/articles.parquet"))}
    history = None
    for folder, split in SPLIT_DIRS.items():
        at = Path(root, folder)
        if not at.is_dir():
            continue
        out[f"behaviors_{split}"] = clean_behaviors(spark.read.parquet(str(at / "behaviors.parquet")), split)
        h = clean_user_history(spark.read.parquet(str(at / "history.parquet")))
        history = h if history is None else history.unionByName(h)
    if history is not None:
        out["user_history"] = history.dropDuplicates(["user_id", "article_id", "click_timestamp"])
    return out


def read_document_vectors(spark: SparkSession, path: str) -> DataFrame:
    """`article_id`, `vec` of a parquet file of document vectors: the first column is the id, the next the vector, whatever its name."""
    raw = spark.read.parquet(path)
    key, vector = raw.columns[:2]
    return raw.select(F.col(key).cast("string").alias("article_id"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null")
