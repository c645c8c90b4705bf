"""Behavioural features, one row per impression and candidate: sessions, recency, category match, freshness, dwell, popularity."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import word_count
from newsloom.operators.history import exploded

#: The half-life of a click, and the names of the features.
HALF_LIFE_HOURS = 72.0
FEATURES = [
    "bm25_score", "embedding_score", "candidate_position", "hist_click_count", "hist_recency_weighted_count", "hist_category_match", "hist_category_match_weighted",
    "candidate_popularity", "freshness_hours", "has_freshness", "hist_avg_dwell_seconds", "session_ordinal", "session_click_count_so_far",
]


def hours_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def recency_weight(click_ts: Column, ts: Column) -> Column:
    return F.exp(F.lit(-log(2.0) / HALF_LIFE_HOURS) * F.greatest(hours_between(click_ts, ts), F.lit(0.0)))


def popularity(imps: DataFrame) -> DataFrame:
    """`article_id`, `clicks`: how often each article was clicked in `imps`."""
    return imps.select(F.explode("clicked").alias("article_id")).groupBy("article_id").agg(F.count(F.lit(1)).alias("clicks"))


def session_features(imps: DataFrame) -> DataFrame:
    """`impression_id`, `session_ordinal` (1 + impressions of the same user and session strictly earlier), `session_click_count_so_far`; 0 without a session."""
    w = Window.partitionBy("user_id", "session_id").orderBy("ts")
    peers = Window.partitionBy("user_id", "session_id", "ts")
    n = F.coalesce(F.size("clicked"), F.lit(0)).cast("long")
    known = imps.where("user_id is not null and session_id is not null").select("impression_id", "user_id", "session_id", "ts", n.alias("n"))
    so_far = F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("n").over(peers)
    found = known.select("impression_id", F.rank().over(w).alias("session_ordinal"), so_far.alias("session_click_count_so_far"))
    none = imps.where("user_id is null or session_id is null").select("impression_id", F.lit(0).alias("session_ordinal"), F.lit(0).cast("long").alias("session_click_count_so_far"))
    return found.unionByName(none)


def history_features(history: DataFrame) -> DataFrame:
    """Per impression: click count (at most the history's length), recency-weighted count, mean dwell (0 without any)."""
    ts = F.col("ts")
    weights = F.transform("hist", lambda x: recency_weight(x["ts"], ts))
    dwell = F.filter(F.transform("hist", lambda x: x["read_time"]), lambda x: x.isNotNull())
    total = F.aggregate(dwell, F.lit(0.0), lambda s, x: s + x)
    return history.select(
        "impression_id", F.size("hist").alias("hist_click_count"), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x).alias("hist_recency_weighted_count"),
        F.when(F.size(dwell) > 0, total / F.size(dwell)).otherwise(F.lit(0.0)).alias("hist_avg_dwell_seconds"),
    )


def category_counts(history: DataFrame, articles: DataFrame) -> DataFrame:
    """`impression_id`, `category`, `n` and recency-weighted `w` of the clicks of each non-null category."""
    h = exploded(history).join(articles.where("category is not null").select("article_id", "category"), "article_id")
    return h.groupBy("impression_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(recency_weight(F.col("click_ts"), F.col("ts"))).alias("w"))


def feature_table(cands: DataFrame, imps: DataFrame, history: DataFrame, articles: DataFrame, clicked: DataFrame, bm25: DataFrame | None = None, emb: DataFrame | None = None) -> DataFrame:
    """All features of `cands` whose impression has a history.

    `clicked` is the popularity table (of the training split, unless a leak is
    studied); `bm25` and `emb` hold `impression_id`, `pos`, `score`, unless `cands` has
    the columns `bm25_score` and `embedding_score`.
    """
    with_hist = history.where(F.size("hist") > 0)
    a = articles.select("article_id", "category", "published_time")
    rows = cands.join(history_features(with_hist), "impression_id").join(a, "article_id", "left").join(clicked, "article_id", "left").join(session_features(imps), "impression_id", "left")
    rows = rows.join(category_counts(with_hist, articles), ["impression_id", "category"], "left")
    for scores, name in ((bm25, "bm25_score"), (emb, "embedding_score")):
        if scores is not None:
            rows = rows.join(scores.select("impression_id", "pos", F.col("score").alias(name)), ["impression_id", "pos"], "left")
    fresh = F.col("published_time").isNotNull()
    zero = F.lit(0.0)
    return rows.select(
        "impression_id", "article_id", "pos", "label",
        F.coalesce("bm25_score", zero).alias("bm25_score"), F.coalesce("embedding_score", zero).alias("embedding_score"), F.col("pos").alias("candidate_position"), "hist_click_count", "hist_recency_weighted_count",
        F.coalesce("n", F.lit(0)).cast("long").alias("hist_category_match"), F.coalesce("w", zero).alias("hist_category_match_weighted"), F.log1p(F.coalesce("clicks", F.lit(0)).cast("double")).alias("candidate_popularity"),
        F.when(fresh, hours_between(F.col("published_time"), F.col("ts"))).otherwise(zero).alias("freshness_hours"), fresh.cast("int").alias("has_freshness"), "hist_avg_dwell_seconds",
        F.coalesce("session_ordinal", F.lit(0)).alias("session_ordinal"), F.coalesce("session_click_count_so_far", F.lit(0).cast("long")).alias("session_click_count_so_far"),
    )


def category_entropy(history: DataFrame, articles: DataFrame) -> DataFrame:
    """`impression_id`, `entropy` (bits) of the categories in each history."""
    c = category_counts(history, articles)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("impression_id"))
    return c.select("impression_id", p.alias("p")).groupBy("impression_id").agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def shown_features(cands: DataFrame, articles: DataFrame) -> DataFrame:
    """Features of the list itself: relative position, number of candidates, title length, share of the candidate's category in the catalogue."""
    freq = articles.where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("category_share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    a = articles.select("article_id", "category", word_count(F.col("title")).alias("title_len")).join(freq, "category", "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("impression_id"))
    rows = cands.withColumn("n_candidates", n).join(a, "article_id", "left")
    return rows.select("impression_id", "article_id", "pos", "n_candidates", (F.col("pos") / F.col("n_candidates")).alias("relative_position"), F.coalesce("title_len", F.lit(0)).alias("title_len"), F.coalesce("category_share", F.lit(0.0)).alias("category_share"))
