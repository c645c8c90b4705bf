"""Searches whose queries meet all items block by block, beside plain ones."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import blocks, bm25, list_scores, metrics, retrieval
from newsloom.plans import reference_queries, study_queries
from test_whole import T0, folder

ARTICLES = "article_id string, title string, abstract string, delivered_at timestamp"


def test_title_search_asks_for_every_article(spark, tmp_path):
    d = folder(spark, tmp_path, articles=([(f"N{i}", f"word{i} news", None, T0) for i in range(1, 8)] + [("N50", None, "news", T0)], ARTICLES))
    got = reference_queries.bm25_search_top50(spark, d).collect()
    assert {r["query_id"] for r in got} == {f"N{i}" for i in range(1, 8)}
    assert all(r["article_id"] == r["query_id"] for r in got if r["rank"] == 1) and len(got) == 7 * 8


def test_bm25_blocks_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    common = np.array([1 / (i + 1) for i in range(60)])
    texts = [" ".join(rng.choice(words, rng.integers(0, 12), p=common / common.sum())) for _ in range(400)]
    i = bm25.build(spark.createDataFrame([(f"A{n}", t, None) for n, t in enumerate(texts)], "article_id string, title string, abstract string"))
    asked = [(f"q{n}", list(set(rng.choice(words, 4)))) for n in range(40)]
    q = spark.createDataFrame(asked, "query_id string, terms array<string>")
    plain = q.select("query_id", F.explode("terms").alias("term")).join(bm25.impacts(i), "term").groupBy("query_id", "article_id").agg(F.round(F.sum("w"), 9).alias("s")).collect()
    want = set()
    for name, _ in asked:
        own = sorted((-r["s"], r["article_id"]) for r in plain if r["query_id"] == name)
        want |= {(name, a, k) for k, (_, a) in enumerate(own[:5], 1)}
    monkeypatch.setattr(blocks, "KEPT", 50)
    for block in (70, 1000):
        assert {(r["query_id"], r["article_id"], r["rank"]) for r in bm25.search(i, q, 5, block).collect()} == want
    only = q.withColumn("want", F.array(F.lit("A7"), F.lit("A9")))
    assert {(r["query_id"], r["article_id"], r["rank"]) for r in bm25.search(i, only, 5).collect()} == {x for x in want if x[1] in ("A7", "A9")}


def test_vector_blocks_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    kinds = [v / np.linalg.norm(v) for v in rng.normal(size=(40, 3))]
    rows = [(f"A{n}", [float(x) for x in kinds[n % 40]]) for n in range(300)]
    v = spark.createDataFrame(rows, "article_id string, vec array<double>")
    q = spark.createDataFrame([(f"q{n}", [float(x) for x in rng.normal(size=3)]) for n in range(30)], "query_id string, vec array<double>")
    want = set()
    for r in q.collect():
        u = np.array(r["vec"]) / np.linalg.norm(r["vec"])
        own = sorted((-round(float(u @ np.array(x)), 9), a) for a, x in rows)
        want |= {(r["query_id"], a, k) for k, (_, a) in enumerate(own[:11], 1)}
    monkeypatch.setattr(blocks, "KEPT", 100)
    for block in (7, 1000):
        assert {(r["query_id"], r["article_id"], r["rank"]) for r in retrieval.search(q, v, 11, block).collect()} == want


def test_recall_of_groups_equals_the_pairs(spark):
    top = spark.createDataFrame([("q", "A", 1), ("q", "B", 2), ("q", "C", 3), ("r", "B", 1)], "query_id string, article_id string, rank int")
    members = spark.createDataFrame([("A", "x"), ("C", "x"), ("D", "x"), ("B", "y"), ("E", None)], "article_id string, g string")
    asked = spark.createDataFrame([("q", "x"), ("r", "y"), ("s", "x"), ("t", None)], "query_id string, g string")
    slow = metrics.recall_at(top, asked.join(members, "g").select("query_id", "article_id"), [1, 3])
    assert sorted(metrics.recall_of_groups(top, asked, members, "g", [1, 3]).collect()) == sorted(slow.collect())


def test_recall_takes_every_eligible_impression(spark, tmp_path, monkeypatch):
    """A sample smaller than the impressions changes nothing."""
    monkeypatch.setattr(study_queries, "SAMPLE", 2)
    imps = [(f"mind_val_{k}", "mind", "u", T0.replace(hour=2), ["N1", "N2"], ["N2"], None, None) for k in range(5)]
    d = folder(
        spark, tmp_path,
        articles=([("N1", "one news", None, T0), ("N2", "two news", None, T0)], ARTICLES),
        behaviors=(imps, "impression_id string, dataset string, user_id string, timestamp timestamp, candidate_article_ids array<string>, clicked_article_ids array<string>, session_id string, read_time double"),
        click_log=([("u", "N1", T0, 1.0)], "user_id string, article_id string, click_timestamp timestamp, read_time double"),
        embeddings=([(0, [1.0] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<float>"),
    )
    assert study_queries.recall_bm25(spark, d).first()["n"] == study_queries.recall_embeddings(spark, d).first()["n"] == 5
    assert {r["n"] for r in study_queries.recall_compare(spark, d).where("slice = 'overall'").collect()} == {5}


def test_list_scores_equal_the_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"A{n}" for n in range(30)]
    title = lambda n: None if n % 7 == 0 else " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 5)))
    articles = spark.createDataFrame([(a, title(n), " ".join(rng.choice(list("abcdefghij"), 6))) for n, a in enumerate(names)], "article_id string, title string, abstract string")
    vectors = spark.createDataFrame([(a, [0.0, 0.0] if n == 3 else [float(n % 5), 1.0]) for n, a in enumerate(names) if n % 4], "article_id string, vec array<double>")
    pick = lambda n: [str(x) for x in rng.choice([*names, "none"], n)]
    hist = [(f"i{k}", [(a,) for a in pick(k % 4)]) for k in range(40)] + [("three", [("A3",)]), ("none", [("none",)])]
    h = spark.createDataFrame(hist, "impression_id string, hist array<struct<article_id:string>>")
    imps = spark.createDataFrame([(i, pick(1 + k % 6)) for k, (i, _) in enumerate(hist)], "impression_id string, cands array<string>")
    cands = imps.select("impression_id", F.posexplode("cands").alias("pos", "article_id"))
    i = bm25.build(articles)
    monkeypatch.setattr(blocks, "KEPT", 2 * list_scores.LISTS)
    monkeypatch.setattr(list_scores, "LISTS", 10)
    monkeypatch.setattr(list_scores, "ARTICLES", 8)
    got = cands.join(list_scores.score_lists(imps, h, articles, i, vectors), "impression_id").collect()
    slow = {"bm25": bm25.score_candidates(i, cands, bm25.history_queries(h, articles)), "emb": retrieval.score_candidates(cands, retrieval.user_vectors(h, vectors, 2), vectors)}
    for m, df in slow.items():
        assert {(r["impression_id"], r["pos"]): round(r["score"], 8) for r in df.collect()} == {(r["impression_id"], r["pos"]): round(r[m][r["pos"]], 8) for r in got if r[m] is not None}
