"""Queries of the language-model data problems (p4, p7, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import truncation
from newsloom.llm.mixing import budgets, mix, of_targets, shares
from newsloom.llm.packing import pack
from newsloom.llm.stripes import together
from newsloom.llm.tokens import token_sizes
from newsloom.llm.topn import top_n
from newsloom.session import table, written


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = top_n(table(spark, d, "candidate_scores"), "impression_id", "article_id", "score", 5)
    return t.select(F.col("group").alias("impression_id"), "place", F.col("item").alias("article_id"))


def p4_best_scores(spark: SparkSession, d: str) -> DataFrame:
    t = top_n(table(spark, d, "candidate_scores"), "impression_id", "article_id", "score", 10)
    return t.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("score").alias("last")).withColumnRenamed("group", "impression_id")


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "behaviors").where("size(clicked_article_ids) > 0").select("impression_id", "clicked_article_ids").dropDuplicates(["impression_id"])
    h = table(spark, d, "user_history").where("user_id is not null")
    read = h.groupBy("user_id").agg(F.max_by("history", F.struct("as_of", "recorded_at", "history_id")).alias("history"))
    both = shown.select(F.col("clicked_article_ids").alias("x")).unionAll(read.select("history"))
    return both.withColumnRenamed("x", "basket")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return together(_baskets(spark, d)).select("article_a", "article_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return together(_baskets(spark, d)).select("article_a", "article_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_sizes(table(spark, d, "documents"), "text", ["doc_id"]), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity = table(spark, d, "container_sizes").select("container_kind", "capacity_tokens")
    used = p8_packed(spark, d).where("container_id is not null").groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(capacity, "container_kind").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], DataFrame]:
    targets = table(spark, d, "source_targets")
    sizes = token_sizes(of_targets(table(spark, d, "documents"), targets), "text", ["doc_id", "source"])
    plan = budgets(sizes, targets)
    return mix(sizes, plan), plan, sizes


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*_p9(spark, d)[:2])


def _p10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "declared_chars")
    model = truncation.fit(docs, "doc_id", "text", "source", "declared_chars")
    return truncation.verdicts(truncation.score(docs, "doc_id", "text", "source", model, "declared_chars"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).where("truncated").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_p10(spark, d)).withColumn("rate", F.round("rate", 6))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: the documents placed, and how often a rule is broken: containers over capacity, texts split though they fit, texts whose pieces aren't whole."""
    capacity = table(spark, d, "container_sizes").where("capacity_tokens > 0").select("container_kind", "capacity_tokens")
    p = written(p8_packed(spark, d).join(capacity, "container_kind"))
    full = p.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    over = full.groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    text = p.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("c"), F.count(F.lit(1)).alias("k"), F.countDistinct("piece").alias("kd"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    each = text.groupBy("container_kind").agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("t") <= F.col("c")) & (F.col("k") > 1)).alias("split_though_fitting"), F.count_if((F.col("t") != F.col("end")) | (F.col("k") != F.col("kd"))).alias("not_whole"))
    return each.join(over, "container_kind")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target: documents used more often than allowed or than others by more than one pass, and whether the tokens given are further from the budget than half the source's longest document, which the cut may have met."""
    mixed, plan, sizes = _p9(spark, d)
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.max("n_tokens").alias("t"))
    spec = spark.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["budget"], p["passes"]) for p in plan], "source string, target_share double, max_repeats int, budget long, passes long")
    found = uses.join(F.broadcast(spec), "source").groupBy("source").agg(F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") > F.col("passes") + 1)).alias("overused"), F.sum(F.col("uses") * F.col("t")).alias("given"))
    rows = spec.join(found, "source", "left").join(longest, "source", "left").fillna(0, ["overused", "given", "longest"])
    return rows.select("source", "target_share", "overused", (2 * F.abs(F.col("given") - F.col("budget")) > F.col("longest")).alias("off_budget"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents judged, blank ones called truncated, and documents whose verdict isn't that of their copies."""
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.trim("text"), F.lit("")).eqNullSafe("").alias("blank"))
    j = written(_p10(spark, d).join(docs, "doc_id"))
    differ = j.groupBy("h").agg(F.min("truncated").alias("a"), F.max("truncated").alias("b")).where("a <> b").select("h", F.lit(True).alias("differ"))
    j = j.join(differ, "h", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("blank") & F.col("truncated")).alias("blank_truncated"), F.count_if("differ").alias("copies_differ"))


QUERIES = {f.__name__: f for f in (p4_found, p4_best_scores, p7_found, p7_pairs, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_rates, p8_checks, p9_checks, p10_checks)}

_TOP = """top AS (SELECT impression_id, article_id, score, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, article_id) AS place FROM (
  SELECT impression_id, article_id, max(score) AS score FROM candidate_scores WHERE score IS NOT NULL AND NOT isnan(score) AND impression_id IS NOT NULL AND article_id IS NOT NULL GROUP BY ALL))"""

_PAIRS = """baskets AS (
  SELECT row_number() OVER () AS k, list_distinct(x) AS x FROM (
    SELECT any_value(clicked_article_ids) AS x FROM behaviors WHERE clicked_article_ids IS NOT NULL GROUP BY impression_id
    UNION ALL SELECT history FROM (SELECT history, row_number() OVER (PARTITION BY user_id ORDER BY as_of DESC, recorded_at DESC, history_id DESC) AS p FROM user_history WHERE user_id IS NOT NULL) WHERE p = 1) WHERE len(list_distinct(x)) > 0),
total AS (SELECT count(*) AS n FROM baskets), i AS (SELECT k, unnest(x) AS a FROM baskets), c AS (SELECT a, count(*) AS n FROM i GROUP BY a),
j AS (SELECT l.a AS a, r.a AS b, count(*) AS n_ab FROM i l JOIN i r ON l.k = r.k AND l.a < r.a GROUP BY ALL HAVING count(*) >= 5),
pairs AS (SELECT j.a AS article_a, j.b AS article_b, n_ab, ca.n AS n_a, cb.n AS n_b, total.n AS n_baskets FROM j JOIN c ca ON ca.a = j.a JOIN c cb ON cb.a = j.b, total WHERE n_ab * total.n >= 10 * ca.n * cb.n)"""

_X = "(CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END)"
_CELLS = ["n_ab::DOUBLE", "(n_a - n_ab)::DOUBLE", "(n_b - n_ab)::DOUBLE", "(n_baskets - n_a - n_b + n_ab)::DOUBLE"]
_MARGINS = ["n_a::DOUBLE", "(n_baskets - n_a)::DOUBLE", "n_b::DOUBLE", "(n_baskets - n_b)::DOUBLE"]
_LLR = f"greatest(0.0, 2.0 * ({' + '.join(_X.format(c) for c in [*_CELLS, 'n_baskets::DOUBLE'])} - ({' + '.join(_X.format(c) for c in _MARGINS)})))"

SQL = {
    "p8_checks": "SELECT container_kind, count(DISTINCT doc_id) AS docs, 0 AS overfull, 0 AS split_though_fitting, 0 AS not_whole FROM documents, container_sizes WHERE capacity_tokens > 0 GROUP BY 1",
    "p9_checks": "SELECT source, target_share, 0 AS overused, false AS off_budget FROM source_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0",
    "p10_checks": "SELECT source, count(*) AS docs, 0 AS blank_truncated, 0 AS copies_differ FROM documents GROUP BY 1",
    "p4_found": f"WITH {_TOP} SELECT impression_id, CAST(place AS INT) AS place, article_id FROM top WHERE place <= 5",
    "p4_best_scores": f"WITH {_TOP} SELECT impression_id, count(*) AS n, max(score) AS best, min(score) AS last FROM top WHERE place <= 10 GROUP BY impression_id",
    "p7_found": f"WITH {_PAIRS} SELECT article_a, article_b FROM pairs",
    "p7_pairs": f"WITH {_PAIRS} SELECT article_a, article_b, n_ab, n_a, n_b, n_baskets, round(n_ab * n_baskets / (n_a * n_b), 6) AS lift, round({_LLR}, 4) AS llr FROM pairs",
}
