"""The second definition of several operators: given histories, floored BM25 with repeated terms, its twelve features, slices and beyond-accuracy figures.

These differ from the main ones on purpose and are never mixed with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import tokenize, word_count
from newsloom.functions.vectors import dot, unit
from newsloom.operators import bm25

IDF_FLOOR = 0.01
RECENT_TITLES = 10
FEATURES = ["hist_len", "user_cat_entropy", "cat_overlap", "cat_overlap_frac", "emb_sim", "emb_sim_decay", "bm25_score", "popularity", "title_len", "cat_freq", "position", "n_candidates"]


def labelled(imps: DataFrame) -> DataFrame:
    """`labels` next to `cands`: 1 and 0, or -1 where the impression is unlabelled."""
    return imps.withColumn("labels", F.transform("cands", lambda a: F.when(F.col("clicked").isNull(), F.lit(-1)).otherwise(F.array_contains("clicked", a).cast("int"))))


def title_terms(given: DataFrame, articles: DataFrame, n: int = RECENT_TITLES, words: Column | None = None) -> DataFrame:
    """`impression_id`, `counts`: how often each word occurs in the last `n` titles of `items` (oldest first); words keep their multiplicity."""
    recent = F.slice("items", F.greatest(F.size("items") - n + 1, F.lit(1)), n)
    t = given.where(F.size("items") > 0).select("impression_id", F.explode(recent).alias("article_id")).join(articles.where("title is not null"), "article_id")
    w = t.select("impression_id", F.explode(tokenize(F.col("title")) if words is None else words).alias("term")).groupBy("impression_id", "term").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy("impression_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "c")))).alias("counts"))


def bm25_scores(cands: DataFrame, counts: DataFrame, articles: DataFrame, words: Column | None = None) -> DataFrame:
    """Floored BM25 of candidates, over `words` of the articles instead of the usual ones if given; a word of the query counts as often as it occurs there; impressions without a query score 0."""
    maps = bm25.impacts(bm25.build(articles, IDF_FLOOR, words)).groupBy("article_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("m"))
    both = cands.join(counts, "impression_id", "left").join(maps, "article_id", "left")
    total = F.aggregate(F.array_sort(F.array_intersect(F.map_keys("m"), F.map_keys("counts"))), F.lit(0.0), lambda s, t: s + F.element_at("m", t) * F.element_at("counts", t))
    return both.withColumn("bm25_score", F.coalesce(total, F.lit(0.0))).drop("m", "counts")


def user_vector(given: DataFrame, vectors: DataFrame, dims: int, rate: float = 0.0) -> DataFrame:
    """`impression_id`, `vec`: mean over the items with a vector, weighted by exp(-rate * age), age 0 for the last."""
    x = given.select("impression_id", F.posexplode("items").alias("k", "article_id")).join(vectors, "article_id")
    age = F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc("k"))) - 1
    x = x.withColumn("w", F.exp(-rate * age))
    cols = x.select("impression_id", "w", *(F.col("vec")[i].alias(f"v{i}") for i in range(dims)))
    return cols.groupBy("impression_id").agg(F.array(*(F.sum(F.col(f"v{i}") * F.col("w")) / F.sum("w") for i in range(dims))).alias("vec"))


def feature_table(cands: DataFrame, given: DataFrame, articles: DataFrame, vectors: DataFrame, clicks: DataFrame, dims: int) -> DataFrame:
    """The twelve features. `given` holds `impression_id` and `items`, the user's whole history, oldest first."""
    a = articles.select("article_id", "title", "abstract", F.coalesce("category", F.lit("UNK")).alias("category"))
    cat = given.select("impression_id", F.explode("items").alias("article_id")).join(a.select("article_id", "category"), "article_id").groupBy("impression_id", "category").agg(F.count(F.lit(1)).alias("n_cat"))
    p = F.col("n_cat") / F.sum("n_cat").over(Window.partitionBy("impression_id"))
    entropy = cat.select("impression_id", p.alias("p")).groupBy("impression_id").agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))).alias("user_cat_entropy"))
    freq = a.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("cat_freq", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")
    most = clicks.agg(F.max("clicks")).first()[0] or 1
    users = [user_vector(given, vectors, dims, r).select("impression_id", unit(F.col("vec")).alias(n)) for n, r in (("u", 0.0), ("ud", 0.1))]
    n = F.count(F.lit(1)).over(Window.partitionBy("impression_id"))
    rows = bm25_scores(cands.withColumn("n_candidates", n), title_terms(given, articles), articles)
    rows = rows.join(given.select("impression_id", F.size("items").alias("hist_len")), "impression_id", "left").join(a.select("article_id", "category", word_count(F.col("title")).alias("title_len")), "article_id", "left")
    rows = rows.join(entropy, "impression_id", "left").join(cat, ["impression_id", "category"], "left").join(freq, "category", "left").join(clicks, "article_id", "left").join(vectors, "article_id", "left")
    rows = rows.join(users[0], "impression_id", "left").join(users[1], "impression_id", "left")
    zero, size = F.lit(0.0), F.coalesce("hist_len", F.lit(0))
    return rows.select(
        "impression_id", "article_id", "pos", "label", size.alias("hist_len"), F.coalesce("user_cat_entropy", zero).alias("user_cat_entropy"), F.col("n_cat").isNotNull().cast("int").alias("cat_overlap"),
        (F.coalesce("n_cat", F.lit(0)) / F.greatest(size, F.lit(1))).alias("cat_overlap_frac"), F.coalesce(dot(F.col("u"), F.col("vec")), zero).alias("emb_sim"), F.coalesce(dot(F.col("ud"), F.col("vec")), zero).alias("emb_sim_decay"),
        "bm25_score", (F.coalesce("clicks", F.lit(0)) / F.lit(most)).alias("popularity"), F.coalesce("title_len", F.lit(0)).alias("title_len"), F.coalesce("cat_freq", zero).alias("cat_freq"),
        (F.col("pos") / F.col("n_candidates")).alias("position"), "n_candidates",
    )


def with_popularity_fallback(scored: DataFrame, has_user: Column, has_vector: Column, clicks: Column) -> DataFrame:
    """Scores with popularity instead where the user has no vector, and below all others where only the candidate has none."""
    pop = F.coalesce(clicks, F.lit(0)).cast("double")
    return scored.withColumn("score", F.when(~has_user, pop).when(~has_vector, F.lit(-1e8) + pop).otherwise(F.col("score")))


def slices(imps: DataFrame, hist_len: DataFrame, clicks: DataFrame) -> DataFrame:
    """`impression_id`, `history` cold/warm at the truncated 25th percentile of history lengths, `target` tail/head at the truncated 80th percentile of the first clicked candidate's popularity."""
    first = F.coalesce(F.get(F.filter("cands", lambda a: F.array_contains("clicked", a)), F.lit(0)), F.get("cands", F.lit(0)))
    x = imps.select("impression_id", first.alias("article_id")).join(clicks, "article_id", "left").join(hist_len, "impression_id", "left")
    x = x.select("impression_id", F.coalesce("hist_len", F.lit(0)).alias("h"), F.coalesce("clicks", F.lit(0)).alias("p"))
    h, p = x.agg(F.floor(F.percentile("h", 0.25)), F.floor(F.percentile("p", 0.8))).first()
    return x.select("impression_id", F.when(F.col("h") <= (h or 0), "cold").otherwise("warm").alias("history"), F.when(F.col("p") <= (p or 0), "tail").otherwise("head").alias("target"))


def novelty10(top: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Mean -log2 of the popularity share, at least 1e-10, over a list."""
    total = F.greatest(F.sum("clicks").over(Window.partitionBy(F.lit(0))), F.lit(1))
    share = clicks.withColumn("share", F.col("clicks") / total).select("article_id", "share")
    return top.join(share, "article_id", "left").groupBy(*keys).agg(F.avg(-F.log2(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1e-10)))).alias("novelty"))


def recall_preview(recalls: DataFrame, hist_len: str, a: str, b: str, cutoff: int = 5, by: list[str] | None = None) -> DataFrame:
    """Mean recall of two methods overall and for short and long histories, and the better one; for each group of `by`."""
    by = by or []
    part = F.explode(F.array(F.lit("overall"), F.when(F.col(hist_len) < cutoff, "short").otherwise("long"))).alias("slice")
    m = recalls.select(*by, part, a, b).groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias(a), F.avg(b).alias(b))
    return m.withColumn("winner", F.when(F.col(a) > F.col(b), a).when(F.col(b) > F.col(a), b).otherwise("tie"))


def parse_shown(shown: Column) -> tuple[Column, Column]:
    """Items and labels (1, 0, or -1 without one) of packed entries `id-label`, cut at the last `-`."""
    labelled = lambda x: x.rlike("-[01]$")
    items = F.transform(shown, lambda x: F.when(labelled(x), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x))
    return items, F.transform(shown, lambda x: F.when(labelled(x), F.right(x, F.lit(1)).cast("int")).otherwise(F.lit(-1)))


def label_popularity(labelled: DataFrame) -> DataFrame:
    """`article_id`, `clicks`: how often each article stands at a place labelled 1."""
    x = labelled.select(F.explode(F.arrays_zip("cands", "labels")).alias("x")).where("x.labels = 1")
    return x.groupBy(F.col("x.cands").alias("article_id")).agg(F.count(F.lit(1)).alias("clicks"))
