"""Queries over the news tables: cleaning, history, retrieval, ranking metrics, features and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.stem import stemmed
from newsloom.functions.text import article_text, plain_words, tokenize
from newsloom.functions.vectors import norm, unit
from newsloom.operators import ablation, bm25, bootstrap, catalogue, features, lambdamart, list_features, list_scores, metrics, neural, profile, retrieval, sampling, splits, variants
from newsloom.operators.history import exploded, leaks, recent_history
from newsloom.plans.reference_sql import SQL  # noqa: F401
from newsloom.session import table, written
from newsloom.sources import mind
from newsloom.sources.sinks import rank_lines

DIMS = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


class Base:
    """The base tables of one input folder."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @property
    def articles(self) -> DataFrame:
        return catalogue.first_delivery(self.t("articles"))

    @property
    def imps(self) -> DataFrame:
        return catalogue.impressions(self.t("behaviors"))

    def cands(self, split: str = "val") -> DataFrame:
        return catalogue.candidates(self.imps.where(F.col("split") == split))

    def history(self, *splits: str) -> DataFrame:
        return recent_history(self.imps.where(F.col("split").isin(*(splits or ("val",)))), catalogue.clicks(self.t("click_log")))

    @property
    def vectors(self) -> DataFrame:
        return catalogue.article_vectors(self.articles.select("article_id"), self.t("embeddings"))

    def popularity(self, *names: str) -> DataFrame:
        return features.popularity(self.imps.where(F.col("split").isin(*(names or ("train",)))))

    def scored_lists(self, split: str = "val", history: DataFrame | None = None) -> DataFrame:
        """The impressions with arrays `bm25` and `emb` beside `cands`, null without a title or a vector in their history."""
        a, shown = written(self.articles.select("article_id", "title", "abstract")), written(self.imps.where(F.col("split") == split))
        v = catalogue.article_vectors(a.select("article_id"), self.t("embeddings"))
        found = written(list_scores.score_lists(shown, self.history(split) if history is None else history, a, bm25.build(a), v))
        return shown.join(found, "impression_id")

    def scores(self, split: str = "val", history: DataFrame | None = None) -> DataFrame:
        """The candidates with `bm25` and `emb`, null for impressions without a title or a vector in their history."""
        c = self.scored_lists(split, history).select("impression_id", "dataset", "split", "user_id", "ts", "clicked", "bm25", "emb", F.posexplode("cands").alias("pos", "article_id"))
        return c.withColumn("label", F.array_contains("clicked", F.col("article_id")).cast("int")).drop("clicked").withColumns({m: F.get(m, F.col("pos")) for m in ("bm25", "emb")})

    def bm25(self, split: str = "val", history: DataFrame | None = None) -> DataFrame:
        return self.scores(split, history).where("bm25 is not null").withColumnRenamed("bm25", "score").drop("emb")

    def emb(self, split: str = "val", history: DataFrame | None = None) -> DataFrame:
        return self.scores(split, history).where("emb is not null").withColumnRenamed("emb", "score").drop("bm25")

    def both(self, split: str = "val") -> DataFrame:
        return self.scores(split).where("bm25 is not null and emb is not null")


# --- text, catalogue, cleaning ---------------------------------------------------------------


@query
def tokenize_articles(s: SparkSession, d: str) -> DataFrame:
    w = tokenize(article_text(F.col("title"), F.col("abstract")))
    return Base(s, d).articles.select("article_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_terms"))


@query
def articles_view(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).articles.select("article_id", "dataset", "title", "category", "subcategory", "published_time", F.col("abstract").isNull().alias("no_abstract"))


@query
def candidates_view(s: SparkSession, d: str) -> DataFrame:
    return catalogue.candidates(Base(s, d).imps).select("impression_id", "user_id", "ts", "pos", "article_id", "label")


@query
def mind_clean_news(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "news_lines").where(F.size(F.split("line", "\t", -1)) == 8)
    return mind.clean_news(raw.select(*mind.split_columns(F.col("line"), mind.NEWS))).select("article_id", "dataset", "title", "abstract", "category", "subcategory", "entities")


def _mind_raw(s: SparkSession, d: str, split: str) -> DataFrame:
    raw = table(s, d, "behavior_lines").where((F.col("split") == split) & (F.size(F.split("line", "\t", -1)) == 5))
    return raw.select(*mind.split_columns(F.col("line"), mind.BEHAVIOR)).withColumn("time", mind.try_time(F.col("time"))).where("time is not null")


@query
def mind_clean_behaviors(s: SparkSession, d: str) -> DataFrame:
    parts = [mind.clean_behaviors(_mind_raw(s, d, x), x) for x in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("impression_id", "user_id", F.col("timestamp").alias("ts"), F.array_join("candidate_article_ids", " ").alias("cands"), F.array_join("clicked_article_ids", " ").alias("clicked"))


@query
def mind_synthetic_history(s: SparkSession, d: str) -> DataFrame:
    return mind.merge_histories([mind.clean_user_history(_mind_raw(s, d, x)) for x in ("train", "val")])


@query
def history_dedup(s: SparkSession, d: str) -> DataFrame:
    return catalogue.clicks(table(s, d, "click_log")).select("user_id", "article_id", "ts")


@query
def entity_labels(s: SparkSession, d: str) -> DataFrame:
    e = F.from_json(F.split_part("entities", F.lit("|"), F.lit(1)), mind.ENTITIES)
    a = Base(s, d).articles.where("dataset = 'mind' and entities is not null")
    return a.select("article_id", F.explode(e).alias("e")).where("e.WikidataId is not null").groupBy("e.WikidataId", "e.Type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("article_id").alias("n_articles")).toDF("wikidata_id", "entity_type", "n", "n_articles")


@query
def temporal_split_counts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "behaviors")
    by = splits.split_of(F.col("timestamp"), F.lit("2019-03-18 16:47:56").cast("timestamp_ntz"), F.lit("2019-03-21 20:22:16").cast("timestamp_ntz"))
    return b.groupBy(by.alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("impression_id").alias("n_ids"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query
def split_overlap(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "behaviors").select("raw_impression_id", F.split("impression_id", "_")[1].alias("split")).distinct()
    x, y = b.toDF("raw_impression_id", "split_a"), b.toDF("raw_impression_id", "split_b")
    return x.join(y, "raw_impression_id").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_shared"))


@query
def hybrid_training_union(s: SparkSession, d: str) -> DataFrame:
    """All val impressions and the train ones whose raw id is not among them, in time order, up to 2.25 times as many."""
    i = Base(s, d).imps.select("impression_id", "split", "ts", F.element_at(F.split("impression_id", "_"), -1).alias("raw"))
    base, extra = i.where("split = 'val'"), i.where("split = 'train'")
    n = base.count()
    more = extra.join(base.select("raw"), "raw", "left_anti").orderBy("ts", "impression_id").limit(int(n * 2.25) - n)
    return base.select("impression_id", "split").unionByName(more.select("impression_id", "split"))


# --- point-in-time history -------------------------------------------------------------------


@query
def recent_history_top20(s: SparkSession, d: str) -> DataFrame:
    return exploded(Base(s, d).history()).select("impression_id", "h", "article_id", "click_ts")


@query
def recent_history_train(s: SparkSession, d: str) -> DataFrame:
    h = Base(s, d).history("train")
    return h.select("impression_id", F.size("hist").alias("n_hist"), F.array_join("hist.article_id", " ").alias("items"))


@query
def cold_start_counts(s: SparkSession, d: str) -> DataFrame:
    h = Base(s, d).history().join(Base(s, d).imps.select("impression_id", "clicked", "dataset"), "impression_id")
    return h.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("hist") == 0).alias("cold"), F.count_if((F.size("hist") > 0) & (F.size("clicked") > 0)).alias("eligible"))


@query
def leakage_violations(s: SparkSession, d: str) -> DataFrame:
    return leaks(Base(s, d).history()).agg(F.count(F.lit(1)).alias("violations"))


@query
def train_articles_only(s: SparkSession, d: str) -> DataFrame:
    """Histories kept to articles clicked in training, in order."""
    b = Base(s, d)
    h = exploded(b.history()).join(b.popularity().select("article_id"), "article_id", "left_semi")
    return h.groupBy("impression_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "article_id"))), lambda x: x["article_id"]), " ").alias("items"))


# --- BM25 -------------------------------------------------------------------------------------


@query
def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    return bm25.build(Base(s, d).articles).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _title_queries(articles: DataFrame) -> DataFrame:
    """`query_id`, `terms`: the words of each title; titles without a word are left out."""
    terms = F.array_distinct(tokenize(F.coalesce("title", F.lit(""))))
    return articles.select(F.col("article_id").alias("query_id"), terms.alias("terms")).where("size(terms) > 0")


def _fiftieth(articles: DataFrame) -> DataFrame:
    """The query articles of `recall_at_k`, as its SQL has them."""
    return articles.where(F.regexp_replace("article_id", "[^0-9]", "").cast("long") % 50 == 0)


@query
def bm25_search_top50(s: SparkSession, d: str) -> DataFrame:
    """The 50 articles nearest to each article's title."""
    a = Base(s, d).articles
    return bm25.search(bm25.build(a), _title_queries(a)).select("query_id", "article_id", "rank", F.round("score", 6).alias("score"))


@query
def bm25_candidate_scores(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).bm25().select("impression_id", "pos", "article_id", "label", F.round("score", 6).alias("score"))


@query
def bm25_candidate_auc(s: SparkSession, d: str) -> DataFrame:
    return metrics.impression_auc(Base(s, d).bm25(), ["impression_id"]).agg(F.count("auc").alias("n"), F.round(F.avg("auc"), 6).alias("auc"))


@query
def bm25_floored_idf(s: SparkSession, d: str) -> DataFrame:
    return bm25.build(Base(s, d).articles, idf_floor=0.01).terms.select("term", F.round("idf", 6).alias("idf"))


# --- vectors ----------------------------------------------------------------------------------


@query
def emb_norms(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(norm(F.col("v")), 5).alias("norm"), F.round(norm(unit(F.col("v"))), 6).alias("unit_norm"))


@query
def emb_user_vectors(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    u = retrieval.user_vectors(b.history(), b.vectors, DIMS)
    return u.select("impression_id", F.posexplode("vec").alias("dim", "x")).select("impression_id", "dim", F.round("x", 6).alias("x"))


@query
def emb_search_top50(s: SparkSession, d: str) -> DataFrame:
    v = Base(s, d).vectors
    q = v.where(F.regexp_replace("article_id", "[^0-9]", "").cast("long") % 50 == 0).select(F.col("article_id").alias("query_id"), "vec")
    return retrieval.search(q, v).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("last_score"), F.round(F.avg("score"), 6).alias("mean_score"))


@query
def emb_candidate_scores(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).emb().select("impression_id", "pos", "article_id", F.round("score", 6).alias("score"))


@query
def decayed_similarity(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    v = b.vectors
    return retrieval.score_candidates(b.cands(), retrieval.decayed_vectors(b.history(), v, DIMS), v).select("impression_id", "pos", F.round("score", 6).alias("score"))


# --- metrics ----------------------------------------------------------------------------------


def _scored(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).emb()


@query
def impression_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.impression_metrics(_scored(s, d), ["impression_id"])
    return m.select("impression_id", *(F.round(c, 6).alias(c) for c in ("auc", "mrr", "ndcg5", "ndcg10")))


@query
def method_comparison(s: SparkSession, d: str) -> DataFrame:
    """Mean metrics of BM25, vectors and popularity over the same val impressions."""
    b = Base(s, d)
    both = written(b.both())
    pop = both.join(b.popularity(), "article_id", "left").withColumn("score", F.coalesce("clicks", F.lit(0)).cast("double"))
    cols = ["impression_id", "pos", "article_id", "label"]
    long = both.select(F.lit("bm25").alias("method"), *cols, F.col("bm25").alias("score")).unionByName(both.select(F.lit("embeddings").alias("method"), *cols, F.col("emb").alias("score"))).unionByName(pop.select(F.lit("popularity").alias("method"), *cols, "score"))
    m = metrics.impression_metrics(long, ["method", "impression_id"])
    return m.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("auc", "mrr", "ndcg5", "ndcg10")))


@query
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    """How many of the articles of a query article's subcategory are among its BM25 hits."""
    b = Base(s, d)
    titles = written(_title_queries(_fiftieth(b.articles)))
    top = bm25.search(bm25.build(b.articles), titles, 200)
    cat = b.articles.where("category is not null").select("article_id", "subcategory")
    q = cat.join(titles.select("query_id"), F.col("article_id") == F.col("query_id")).select("query_id", "subcategory")
    r = metrics.recall_of_groups(top, q, cat, "subcategory", [50, 100, 200])
    return r.select("query_id", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (50, 100, 200)))


def _top5(s: SparkSession, d: str) -> DataFrame:
    return metrics.top_lists(_scored(s, d), ["impression_id"], 5)


@query
def diversity5(s: SparkSession, d: str) -> DataFrame:
    x = metrics.diversity(_top5(s, d), Base(s, d).vectors, ["impression_id"])
    return x.select("impression_id", F.round("diversity", 6).alias("diversity"))


@query
def novelty5(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    pop = b.popularity()
    total = pop.agg(F.sum("clicks")).first()[0] or 0
    return metrics.novelty(_top5(s, d), pop, total, b.articles.count(), ["impression_id"]).select("impression_id", F.round("novelty", 6).alias("novelty"))


@query
def coverage5(s: SparkSession, d: str) -> DataFrame:
    top = _top5(s, d)
    return metrics.coverage(top, Base(s, d).articles.count(), ["split"]).select("split", F.round("coverage", 6).alias("coverage"))


# --- fusion -----------------------------------------------------------------------------------


@query
def hybrid_alpha_grid(s: SparkSession, d: str) -> DataFrame:
    return retrieval.alpha_grid(Base(s, d).both()).select("alpha", "n", F.round("auc", 6).alias("auc"))


@query
def hybrid_scores(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).both().select("impression_id", "pos", F.round(retrieval.hybrid(F.col("bm25"), F.col("emb"), 0.3), 6).alias("score"))


@query
def minmax_fusion(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d).both()
    return b.select("impression_id", "pos", F.round(retrieval.hybrid(retrieval.minmax(F.col("bm25")), retrieval.minmax(F.col("emb")), 0.5), 6).alias("score"))


# --- features ---------------------------------------------------------------------------------


@query
def train_popularity(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).popularity()


@query
def hindsight_popularity(s: SparkSession, d: str) -> DataFrame:
    return Base(s, d).popularity("train", "val")


@query
def session_features(s: SparkSession, d: str) -> DataFrame:
    return features.session_features(Base(s, d).imps)


@query
def history_features(s: SparkSession, d: str) -> DataFrame:
    f = features.history_features(Base(s, d).history().where(F.size("hist") > 0))
    return f.select("impression_id", "hist_click_count", F.round("hist_recency_weighted_count", 6).alias("recency"), F.round("hist_avg_dwell_seconds", 4).alias("dwell"))


@query
def category_match(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    return features.category_counts(b.history(), b.articles).select("impression_id", "category", "n", F.round("w", 6).alias("w"))


@query
def freshness(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    c = b.cands().join(b.articles.select("article_id", "published_time"), "article_id", "left")
    return c.select("impression_id", "pos", F.round(F.coalesce(features.hours_between(F.col("published_time"), F.col("ts")), F.lit(0.0)), 6).alias("hours"), F.col("published_time").isNotNull().cast("int").alias("has_freshness"))


def _feature_table(s: SparkSession, d: str, split: str = "val", pop: tuple[str, ...] = ("train",), mixed: bool = False) -> DataFrame:
    """The features of all candidates; with `mixed`, of the impressions that have clicked and unclicked ones."""
    b = Base(s, d)
    h = written(b.history(split))
    return list_features.feature_table(b.scored_lists(split, h), b.imps, h, b.articles, b.popularity(*pop), mixed)


@query
def feature_table(s: SparkSession, d: str) -> DataFrame:
    f = _feature_table(s, d)
    ints = {"candidate_position", "hist_click_count", "hist_category_match", "has_freshness", "session_ordinal", "session_click_count_so_far"}
    return f.select("impression_id", "article_id", "pos", "label", *(F.col(c) if c in ints else F.round(c, 5).alias(c) for c in features.FEATURES))


@query
def category_entropy(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    return features.category_entropy(b.history(), b.articles).select("impression_id", F.round("entropy", 6).alias("entropy"))


@query
def shown_features(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    f = features.shown_features(b.cands(), b.articles)
    return f.select("impression_id", "article_id", "pos", "n_candidates", F.round("relative_position", 6).alias("relative_position"), "title_len", F.round("category_share", 6).alias("category_share"))


# --- ranks and rank lists ---------------------------------------------------------------------


@query
def rank_order_by_score(s: SparkSession, d: str) -> DataFrame:
    return metrics.ranked(_scored(s, d), ["impression_id"]).select("impression_id", "pos", "rank")


@query
def popularity_rank_order(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    c = b.cands().join(b.popularity(), "article_id", "left").withColumn("score", F.coalesce("clicks", F.lit(0)))
    return metrics.ranked(c, ["impression_id"]).select("impression_id", "pos", "score", "rank")


@query
def submission_lines(s: SparkSession, d: str) -> DataFrame:
    """Rank lists of all test rows as delivered, by popularity: grouped by row, as a raw id may stand for many impressions."""
    b = Base(s, d)
    test = table(s, d, "behaviors").where("clicked_article_ids is null")
    keyed = sampling.dense_numbers(test.select("raw_impression_id", "impression_id", "user_id", "timestamp", "ingested_at", "candidate_article_ids"), "timestamp", "impression_id", "user_id", "ingested_at", "candidate_article_ids")
    c = keyed.select(F.col("row_no").alias("seq"), "raw_impression_id", F.posexplode("candidate_article_ids").alias("pos", "article_id"))
    c = c.join(b.popularity(), "article_id", "left").withColumn("score", F.coalesce("clicks", F.lit(0)).cast("double"))
    return rank_lines(c)


# --- slices, leaks ----------------------------------------------------------------------------


@query
def slice_cold_warm(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    h = written(b.history())
    m = metrics.impression_metrics(b.emb(history=h), ["impression_id"]).join(h.select("impression_id", F.when(F.size("hist") < 5, "cold_start").otherwise("warm").alias("slice")), "impression_id")
    return m.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query
def slice_head_tail(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    pop = b.popularity()
    limit = metrics.head_threshold(pop) or 0.0
    first = b.imps.where("split = 'val' and size(clicked) > 0").select("impression_id", F.col("clicked")[0].alias("article_id")).join(pop, "article_id", "left")
    part = first.select("impression_id", F.when(F.coalesce("clicks", F.lit(0)) < limit, "tail").otherwise("head").alias("slice"))
    m = metrics.impression_auc(_scored(s, d), ["impression_id"]).where("auc is not null").join(part, "impression_id")
    return m.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("auc"), 6).alias("auc"))


@query
def slice_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    """Impressions and clicks by dataset, split and both, in one pass."""
    i = Base(s, d).imps.select("dataset", "split", F.size("clicked").alias("c"))
    return i.cube("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("clicks"))


@query
def leaked_history(s: SparkSession, d: str) -> DataFrame:
    """Histories with the user's other clicks of the same split added, as the leak study wants them."""
    b = Base(s, d)
    return ablation.leaked_history(b.history(), b.imps.where("split = 'val'"), b.articles).select("impression_id", F.size("hist").alias("n_hist"), F.array_join(F.array_sort("hist.article_id"), " ").alias("items"))


@query
def leaked_history_auc(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    h, v, shown = written(b.history()), b.vectors, b.cands()
    out = None
    for kind, users in (("clean", retrieval.user_vectors(h, v, DIMS)), ("leaked", ablation.leaked_user_vectors(h, b.imps.where("split = 'val'"), b.articles, v, DIMS))):
        auc = metrics.impression_auc(retrieval.score_candidates(shown, users, v), ["impression_id"]).agg(F.round(F.avg("auc"), 6).alias("auc")).withColumn("kind", F.lit(kind))
        out = auc if out is None else out.unionByName(auc)
    return out


# --- sampling, intervals, learning to rank ------------------------------------------------------


#: Fixed value: the size of the sample that intervals are taken over.
SAMPLE = 5000


def _sample(b: Base) -> DataFrame:
    """`impression_id` of the seeded sample of val impressions."""
    i = sampling.dense_numbers(b.imps.where("split = 'val'").select("impression_id", "ts"), "ts", "impression_id")
    return sampling.seeded_sample(i, i.count(), SAMPLE).select("impression_id", "ts", "draw")


def _val_metrics(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    x = b.both().join(written(_sample(b)).select("impression_id"), "impression_id", "left_semi")
    long = x.select(F.lit("bm25").alias("method"), "impression_id", "pos", "label", F.col("bm25").alias("score")).unionByName(x.select(F.lit("embeddings").alias("method"), "impression_id", "pos", "label", F.col("emb").alias("score")))
    return metrics.impression_metrics(long, ["method", "impression_id"])


@query
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    """5,000 val impressions (all, if there are fewer), as a seeded draw from their list in time order."""
    return _sample(Base(s, d))


@query
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    m = _val_metrics(s, d)
    long = m.select("method", "impression_id", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("auc", "mrr", "ndcg5", "ndcg10")))).alias("x")).select("method", "impression_id", "x.*")
    return bootstrap.grouped_ci(long, ["method", "metric"], "value", "impression_id")


@query
def paired_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    m = written(_val_metrics(s, d)).withColumn("metric", F.lit("auc"))
    return bootstrap.paired_grouped_ci(m.where("method = 'bm25'"), m.where("method = 'embeddings'"), ["metric"], "impression_id", "auc")


@query
def coverage_ci(s: SparkSession, d: str) -> DataFrame:
    top = _top5(s, d).join(written(_sample(Base(s, d))).select("impression_id"), "impression_id", "left_semi")
    lists = top.groupBy("split", "impression_id").agg(F.collect_list("article_id").alias("items"))
    return bootstrap.coverage_ci(lists, ["split"], "items", "impression_id", Base(s, d).articles.count())


@query
def training_frame(s: SparkSession, d: str) -> DataFrame:
    return lambdamart.training_frame(Base(s, d).cands("train")).select("impression_id", "pos", "article_id", "label")


@query
def learned_alpha(s: SparkSession, d: str) -> DataFrame:
    """The hybrid's weight, learned on train and applied to val."""
    b = Base(s, d)
    alpha = retrieval.learn_alpha(b.both("train"))
    val = b.both().withColumn("score", F.round(retrieval.hybrid(F.col("bm25"), F.col("emb"), alpha), 9))
    return metrics.impression_auc(val, ["impression_id"]).agg(F.lit(alpha).alias("alpha"), F.count("auc").alias("n"), F.round(F.avg("auc"), 6).alias("auc"))


def _ranker(s: SparkSession, d: str, pop: tuple[str, ...] = ("train",)) -> lambdamart.Ranker:
    """Fitted on all candidates of the training split, 200 trees."""
    return lambdamart.train(_feature_table(s, d, "train", pop, mixed=True), features.FEATURES, framed=True)


@query
def ltr_scores(s: SparkSession, d: str) -> DataFrame:
    val = _feature_table(s, d)
    return lambdamart.score(val, _ranker(s, d), ["impression_id", "pos", "label"])


@query
def ltr_importance(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(_ranker(s, d).importance(), "feature string, gain double")


@query
def ltr_leaked_popularity(s: SparkSession, d: str) -> DataFrame:
    """Mean AUC of the ranker with popularity of the training split, and with that of train and val together; `delta` is the mean of what the leak adds, with its interval over a seeded sample."""
    b, aucs = Base(s, d), []
    for kind, pop in (("clean", ("train",)), ("leaked", ("train", "val"))):
        auc = metrics.impression_auc(lambdamart.score(_feature_table(s, d, "val", pop), _ranker(s, d, pop), ["impression_id", "pos", "label"]), ["impression_id"])
        aucs.append(written(auc.where("auc is not null").withColumn("kind", F.lit(kind))))
    means = aucs[0].unionByName(aucs[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("auc").alias("auc")).select("kind", "n", "auc", *(F.lit(None).cast("double").alias(c) for c in ("low", "high")))
    one, two = (a.join(written(_sample(b)).select("impression_id"), "impression_id", "left_semi").withColumn("metric", F.lit("auc")) for a in aucs)
    delta = bootstrap.paired_grouped_ci(one, two, ["metric"], "impression_id", "auc")
    return means.unionByName(delta.select(F.lit("delta").alias("kind"), "n", F.col("mean").alias("auc"), "low", "high"))


def _neural_scores(b: Base, held_out: int | None = None, **how) -> DataFrame:
    """Fitted on all impressions of the training split, applied to val."""
    v, h = b.vectors, written(b.history("train", "val").select("impression_id", F.transform("hist", lambda x: F.struct(x["article_id"].alias("article_id"))).alias("hist")))
    train, val = (neural.lists(b.imps.where(F.col("split") == split), h) for split in ("train", "val"))
    found = neural.score_lists(val, v, neural.fit(train, v, DIMS, held_out, **how))
    return found.select("impression_id", F.posexplode(F.arrays_zip("l", "s")).alias("pos", "x")).select("impression_id", "pos", F.col("x.l").alias("label"), F.col("x.s").alias("score"))


@query
def nrms_scores(s: SparkSession, d: str) -> DataFrame:
    return _neural_scores(Base(s, d), **neural.FORMS["base"], positions=True)


@query
def nrms_improved_scores(s: SparkSession, d: str) -> DataFrame:
    """The improved form: warm-up and cosine rate, weight decay, and as many epochs as are best for a tenth of the training impressions by weights learned of the others; then all are learned from."""
    return _neural_scores(Base(s, d), 10, **neural.FORMS["improved"], negatives=8, warmup=0.1, decay=0.01)


# --- the second definitions -------------------------------------------------------------------


def _given(b: Base) -> DataFrame:
    """Each val impression with its user's latest history, oldest first, whatever its time."""
    h = b.t("user_history").where("user_id is not null").groupBy("user_id").agg(F.max_by("history", F.struct("as_of", "recorded_at", "history_id")).alias("items"))
    return b.imps.where("split = 'val'").select("impression_id", "user_id").join(h, "user_id", "left").select("impression_id", "items")


@query
def given_history_features(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    f = variants.feature_table(b.cands(), _given(b), b.articles, b.vectors, b.popularity(), DIMS)
    ints = {"hist_len", "cat_overlap", "title_len", "n_candidates"}
    return f.select("impression_id", "article_id", "pos", "label", *(F.col(c) if c in ints else F.round(c, 5).alias(c) for c in variants.FEATURES))


@query
def percentile_slices(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    return variants.slices(b.imps.where("split = 'val'"), _given(b).select("impression_id", F.size("items").alias("hist_len")), b.popularity())


@query
def novelty10(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    top = metrics.top_lists(_scored(s, d), ["impression_id"], 10)
    return variants.novelty10(top, b.popularity(), ["impression_id"]).select("impression_id", F.round("novelty", 6).alias("novelty"))


@query
def fallback_scores(s: SparkSession, d: str) -> DataFrame:
    b = Base(s, d)
    v = b.vectors
    scored = b.cands().join(b.emb().select("impression_id", "pos", "score"), ["impression_id", "pos"], "left").join(v, "article_id", "left").join(b.popularity(), "article_id", "left")
    f = variants.with_popularity_fallback(scored, F.col("score").isNotNull(), F.col("vec").isNotNull(), F.col("clicks"))
    return f.select("impression_id", "pos", F.round("score", 6).alias("score"))


@query
def stemmed_terms(s: SparkSession, d: str) -> DataFrame:
    """Document frequencies of stems: English and Danish articles by dataset."""
    a = Base(s, d).articles
    text = plain_words(article_text(F.col("title"), F.col("abstract")), [])
    parts = [a.where(F.col("dataset") == ds).select("article_id", F.lit(lang).alias("lang"), stemmed(text, lang).alias("w")) for ds, lang in (("mind", "en"), ("ebnerd", "da"))]
    return parts[0].unionByName(parts[1]).select("article_id", "lang", F.explode(F.array_distinct("w")).alias("stem")).groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("df"))


# --- profiles ---------------------------------------------------------------------------------


@query
def null_audit(s: SparkSession, d: str) -> DataFrame:
    return profile.null_audit(table(s, d, "articles"))


@query
def value_counts(s: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(Base(s, d).articles, "dataset", "category")


@query
def behaviour_stats(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "behaviors").withColumn("n_candidates", F.size("candidate_article_ids"))
    return profile.numeric_summary(b, "n_candidates")


@query
def impressions_per_user(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "behaviors").where("user_id is not null")
    n = F.size("clicked_article_ids")
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("impression_id").alias("n_ids"), F.sum(F.coalesce(n, F.lit(0))).alias("clicks"), F.min("timestamp").alias("first_ts"))


@query
def plain_word_counts(s: SparkSession, d: str) -> DataFrame:
    w = plain_words(F.col("text"), ["the", "and", "of", "og", "i", "der", "die", "das"])
    return table(s, d, "documents").select("doc_id", F.size(w).alias("n_words"))

