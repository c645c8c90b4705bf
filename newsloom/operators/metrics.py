"""Ranking metrics over scored candidates, slices of impressions, and beyond-accuracy measures.

The hub is the scored table: impression_id, article_id, pos, label, score and any
grouping columns (such as method).
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.vectors import dot


def _average_ranks(scored: DataFrame, keys: list[str]) -> DataFrame:
    by_score = Window.partitionBy(*keys).orderBy("score")
    tied = Window.partitionBy(*keys, "score")
    return scored.withColumn("_r", F.rank().over(by_score) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def _auc() -> Column:
    """Over the rows of a group with `_r` and `label`."""
    pos, n = F.sum("label"), F.count(F.lit(1))
    hit = F.sum(F.when(F.col("label") == 1, F.col("_r")))
    return F.when((pos > 0) & (pos < n), (hit - pos * (pos + 1) / 2.0) / (pos * (n - pos)))


def impression_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUC with average ranks; null where only one label occurs."""
    return _average_ranks(scored, keys).groupBy(*keys).agg(_auc().alias("auc"))


def ranked(scored: DataFrame, keys: list[str]) -> DataFrame:
    """With `rank` from 1: by score descending, equal scores by candidate position."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")))


def ndcg(k: int) -> Column:
    """Over the rows of a group with `rank` and `label`."""
    gain = F.coalesce(F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= k), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0))), F.lit(0.0))
    ideal = F.element_at(F.array(*(F.lit(sum(_discount(i) for i in range(1, m + 1))) for m in range(k + 1))), F.least(F.sum("label"), F.lit(k)).cast("int") + 1)
    return F.when(ideal > 0, gain / ideal).otherwise(F.lit(0.0))


def _discount(rank: int) -> float:
    return 1 / log2(rank + 1)


def impression_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """`auc`, `mrr`, `ndcg5`, `ndcg10` per group, for groups with both labels."""
    first = F.coalesce(1.0 / F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(0.0))
    return ranked(_average_ranks(scored, keys), keys).groupBy(*keys).agg(_auc().alias("auc"), first.alias("mrr"), ndcg(5).alias("ndcg5"), ndcg(10).alias("ndcg10")).where("auc is not null")


def top_lists(scored: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    return ranked(scored, keys).where(F.col("rank") <= k)


def recall_at(top: DataFrame, clicked: DataFrame, ks: list[int]) -> DataFrame:
    """Per query `recall_<k>`: distinct clicked items among the first k over distinct clicked items (`query_id`, `article_id`)."""
    asked = clicked.distinct()
    hits = asked.join(top.select("query_id", "article_id", "rank"), ["query_id", "article_id"], "left")
    return hits.groupBy("query_id").agg(*((F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks))


def recall_of_groups(top: DataFrame, asked: DataFrame, members: DataFrame, group: str, ks: list[int]) -> DataFrame:
    """As `recall_at` where all `members` (`article_id`, `group`) of a query's group (`asked`: `query_id`, `group`) are relevant: their pairs are only counted."""
    sizes = members.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    hits = top.select("query_id", "article_id", "rank").join(members, "article_id").join(asked, ["query_id", group])
    found = hits.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks))
    every = asked.join(sizes, group).join(found, "query_id", "left")
    return every.select("query_id", *((F.coalesce(f"_{k}", F.lit(0)) / F.col("_n")).alias(f"recall_{k}") for k in ks))


def diversity(top: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (1 - cosine) over the pairs of a list that have vectors; lists with fewer than two have no row."""
    t = top.join(vectors, "article_id").select(*keys, "rank", "vec")
    lists = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).alias("l")).where(F.size("l") > 1)
    pair = lists.select(*keys, "l", F.posexplode("l").alias("i", "a"))
    pair = pair.select(*keys, "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))  # at most the list's length a row
    return pair.groupBy(*keys).agg(F.avg(1 - dot(F.col("a.vec"), F.col("b.vec"))).alias("diversity"))


def novelty(top: DataFrame, popularity: DataFrame, total: int, catalogue: int, keys: list[str]) -> DataFrame:
    """Mean -log2((clicks + 1) / (total + catalogue)) of a list."""
    p = top.join(popularity, "article_id", "left").withColumn("_p", (F.coalesce("clicks", F.lit(0)) + 1) / F.lit(total + catalogue))
    return p.groupBy(*keys).agg(F.avg(-F.log2("_p")).alias("novelty"))


def coverage(top: DataFrame, catalogue: int, keys: list[str]) -> DataFrame:
    return top.groupBy(*keys).agg((F.countDistinct("article_id") / F.lit(catalogue)).alias("coverage"))


def head_threshold(popularity: DataFrame, p: float = 0.75) -> float | None:
    """The linearly interpolated percentile of the clicks."""
    return popularity.agg(F.percentile("clicks", p)).first()[0]
