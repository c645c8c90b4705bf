import datetime as dt
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import article_text, plain_words, tokenize, word_count
from newsloom.functions.vectors import cosine, mean_pool, unit
from newsloom.operators import ablation, bm25, bootstrap, catalogue, features, metrics, profile, retrieval, sampling, splits
from newsloom.operators.history import exploded, leaks, recent_history
from newsloom.schemas import ARTICLES, assert_schema, empty_frame
from newsloom.sources import download, ebnerd, mind, sinks

T0 = dt.datetime(2024, 1, 1, 10)
day = lambda n: T0 + dt.timedelta(days=n)


# --- text and vectors -------------------------------------------------------------------------


def test_tokenizer_is_unicode(spark):
    r = spark.createDataFrame([("Århus été_1 x² Don't", None)], "t string, a string").select(tokenize(F.col("t")).alias("w"), tokenize(article_text(F.col("a"), F.col("a"))).alias("e"), word_count(F.col("t")).alias("n"), word_count(F.col("a")).alias("z")).first()
    assert r["w"] == ["århus", "été_1", "x²", "don", "t"] and r["e"] == [] and (r["n"], r["z"]) == (4, 0)
    assert spark.createDataFrame([("<b>The Cats</b> &amp; 3 dogs a",)], "t string").select(plain_words(F.col("t"), ["the"])).first()[0] == ["cats", "dogs"]


def test_vectors(spark):
    df = spark.createDataFrame([("q", [3.0, 4.0]), ("q", [0.0, 0.0])], "k string, vec array<double>")
    assert [r[0] for r in df.select(unit(F.col("vec"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert mean_pool(df, "k", "vec", 2).first()["vec"] == [1.5, 2.0]
    assert df.select(cosine(F.col("vec"), F.array(F.lit(3.0), F.lit(4.0)))).collect()[0][0] == pytest.approx(1)


# --- BM25 -------------------------------------------------------------------------------------

DOCS = [("A1", "senate votes on budget", "politics today"), ("A2", "sunny weather", None), ("A3", "budget senate senate", "vote"), ("A4", None, None)]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(DOCS, "article_id string, title string, abstract string")


def slow_bm25(query):
    words = {a: f"{t or ''} {b or ''}".split() for a, t, b in DOCS}
    n, avg = len(words), np.mean([len(w) for w in words.values()])
    out = {}
    for a, w in words.items():
        for q in set(query):
            if q in w:
                df = sum(q in x for x in words.values())
                tf = w.count(q)
                out[a] = out.get(a, 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
    return out


def test_bm25(spark, articles):
    i = bm25.build(articles)
    assert i.n_docs == 4 and i.avgdl == pytest.approx(3.0)
    q = spark.createDataFrame([("q", "senate"), ("q", "budget"), ("q", "unknown")], "query_id string, term string")
    got = {r["article_id"]: r["score"] for r in bm25.search(i, q, 10).collect()}
    assert got == pytest.approx(slow_bm25(["senate", "budget"])) and set(got) == {"A1", "A3"}
    assert [r["article_id"] for r in bm25.search(i, q, 1).collect()] == ["A3"]
    cands = spark.createDataFrame([("i", 0, "A2"), ("i", 1, "A3"), ("i", 2, "ZZ"), ("i", 3, "A3"), ("i", 4, "A4")], "impression_id string, pos int, article_id string")
    terms = spark.createDataFrame([("i", ["senate", "budget"])], "impression_id string, terms array<string>")
    rows = {r["pos"]: r["score"] for r in bm25.score_candidates(i, cands, terms).collect()}
    assert rows == pytest.approx({0: 0.0, 1: slow_bm25(["senate", "budget"])["A3"], 2: 0.0, 3: slow_bm25(["senate", "budget"])["A3"], 4: 0.0})


# --- vectors and fusion -----------------------------------------------------------------------


def test_retrieval(spark):
    v = spark.createDataFrame([("A1", [1.0, 0.0]), ("A2", [0.0, 1.0]), ("A3", [0.8, 0.6]), ("A4", [0.8, 0.6])], "article_id string, vec array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.1]), ("zero", [0.0, 0.0])], "query_id string, vec array<double>")
    for block in (1, 2, 100):
        assert [(r["query_id"], r["article_id"]) for r in retrieval.search(q, v, 3, block).orderBy("rank").collect()] == [("q", "A1"), ("q", "A3"), ("q", "A4")]
    h = spark.createDataFrame([("i", [("A1",), ("A2",), ("none",)]), ("j", [])], "impression_id string, hist array<struct<article_id:string>>")
    u = retrieval.user_vectors(h, v, 2)
    assert [(r["impression_id"], r["vec"]) for r in u.collect()] == [("i", [0.5, 0.5])]
    w = np.exp([0, -0.1])
    assert retrieval.decayed_vectors(h, v, 2).first()["vec"] == pytest.approx(list(w / w.sum()))
    c = spark.createDataFrame([("i", 0, "A1"), ("i", 1, "none"), ("j", 0, "A1")], "impression_id string, pos int, article_id string")
    assert {r["pos"]: r["score"] for r in retrieval.score_candidates(c, u, v).collect()} == pytest.approx({0: np.sqrt(0.5), 1: 0.0})


def test_learned_weight_takes_the_informative_side(spark):
    rows = [(str(i), k, int(k == i % 3), float(k == i % 3), 0.5) for i in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "impression_id string, pos int, label int, bm25 double, emb double")
    assert retrieval.learn_alpha(df) == 0.05 and retrieval.learn_alpha(df.select("impression_id", "pos", "label", F.col("emb").alias("bm25"), F.col("bm25").alias("emb"))) == 0.0
    assert retrieval.learn_alpha(df.withColumn("label", F.lit(1))) == 0.5
    assert {r[0] for r in df.select(retrieval.minmax(F.col("emb"))).collect()} == {0.0}


# --- metrics ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("labels", "scores", "auc", "mrr", "ndcg5"), [
    ([1, 0, 0], [3, 2, 1], 1.0, 1.0, 1.0), ([0, 0, 1], [3, 2, 1], 0.0, 1 / 3, 0.5), ([1, 0], [1, 1], 0.5, 1.0, 1.0), ([0, 1], [1, 1], 0.5, 0.5, 1 / np.log2(3)),
    ([0, 0, 0, 0, 0, 1], [6, 5, 4, 3, 2, 1], 0.0, 1 / 6, 0.0), ([1, 0, 1, 0], [1, 2, 3, 4], 0.25, 0.5, (1 / np.log2(3) + 1 / np.log2(5)) / (1 + 1 / np.log2(3))),
])
def test_metrics(spark, labels, scores, auc, mrr, ndcg5):
    df = spark.createDataFrame([("i", k, a, float(b)) for k, (a, b) in enumerate(zip(labels, scores, strict=True))] + [("one class", 0, 1, 1.0)], "impression_id string, pos int, label int, score double")
    (r,) = metrics.impression_metrics(df, ["impression_id"]).collect()
    assert (r["auc"], r["mrr"], r["ndcg5"]) == pytest.approx((auc, mrr, ndcg5))
    assert {x["impression_id"]: x["auc"] for x in metrics.impression_auc(df, ["impression_id"]).collect()}["one class"] is None


def test_beyond_accuracy(spark):
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [1.0, 0.0]), ("C", [0.0, 1.0])], "article_id string, vec array<double>")
    top = spark.createDataFrame([("same", "A", 1), ("same", "B", 2), ("far", "A", 1), ("far", "C", 2), ("single", "A", 1), ("single", "none", 2)], "impression_id string, article_id string, rank int")
    assert {r["impression_id"]: r["diversity"] for r in metrics.diversity(top, v, ["impression_id"]).collect()} == pytest.approx({"same": 0.0, "far": 1.0})
    pop = spark.createDataFrame([("A", 9)], "article_id string, clicks long")
    one = top.where("impression_id = 'single' and rank = 1")
    assert metrics.novelty(one, pop, 10, 10, ["impression_id"]).first()["novelty"] == pytest.approx(1.0)
    assert metrics.coverage(top.withColumn("all", F.lit(1)), 8, ["all"]).first()["coverage"] == 0.5
    assert metrics.head_threshold(spark.createDataFrame([(1,), (2,), (3,), (10,)], "clicks long")) == 4.75
    r = metrics.recall_at(spark.createDataFrame([("q", "A", 1), ("q", "B", 2)], "query_id string, article_id string, rank int"), spark.createDataFrame([("q", "B"), ("q", "B"), ("q", "Z")], "query_id string, article_id string"), [1, 2]).first()
    assert (r["recall_1"], r["recall_2"]) == (0.0, 0.5)


def test_bootstrap():
    v = np.random.default_rng(1).normal(size=70)
    rng = np.random.default_rng(42)
    means = v[rng.integers(0, 70, size=(1000, 70))].mean(axis=1)
    assert bootstrap.ci(v) == pytest.approx((v.mean(), *np.percentile(means, [2.5, 97.5])))
    assert bootstrap.ci(np.ones(5)) == (1.0, 1.0, 1.0) and np.isnan(bootstrap.ci(np.array([]))[0])
    assert bootstrap.paired_ci(np.zeros(9), np.ones(9))[3] and not bootstrap.paired_ci(v, v)[3]
    with pytest.raises(ValueError):
        bootstrap.paired_ci(np.zeros(2), np.zeros(3))


def test_grouped_intervals(spark):
    df = spark.createDataFrame([("m", i, float(i % 5) if i else None) for i in range(60)], "m string, o int, v double")
    r = bootstrap.grouped_ci(df, ["m"], "v", "o").first()
    assert (r["mean"], r["low"], r["high"]) == pytest.approx(bootstrap.ci(np.array([float(i % 5) for i in range(1, 60)]))) and r["n"] == 59
    p = bootstrap.paired_grouped_ci(df, df.withColumn("v", F.col("v") + 1), ["m"], "o", "v").first()
    assert p["mean"] == 1.0 and p["significant"]
    c = bootstrap.coverage_ci(spark.createDataFrame([("m", i, [f"a{i}", "b"]) for i in range(9)], "m string, o int, l array<string>"), ["m"], "l", "o", 20).first()
    assert c["coverage"] == 0.5 and c["low"] <= c["high"] < 0.5


# --- history, sessions, features --------------------------------------------------------------


def test_recent_history(spark):
    clicks = [("u", f"A{i}", day(i), float(i)) for i in range(1, 6)] + [("v", "B", day(1), None), ("v", "C", day(1), 1.0), (None, "X", day(1), 1.0)]
    events = [("i1", "u", day(3)), ("i2", "u", day(9)), ("i3", "u", day(1)), ("i4", "nobody", day(3)), ("i5", None, day(3)), ("i6", "v", day(2)), ("i7", "v", day(1))]
    c = spark.createDataFrame(clicks, "user_id string, article_id string, ts timestamp_ntz, read_time double").where("user_id is not null")
    e = spark.createDataFrame(events, "impression_id string, user_id string, ts timestamp_ntz")
    got = {r["impression_id"]: [x["article_id"] for x in r["hist"]] for r in recent_history(e, c, 3).collect()}
    assert got == {"i1": ["A2", "A1"], "i2": ["A5", "A4", "A3"], "i3": [], "i4": [], "i5": [], "i6": ["C", "B"], "i7": []}
    assert leaks(recent_history(e, c)).count() == 0


def test_history_equals_brute_force(spark):
    rng = random.Random(8)
    clicks = sorted({(rng.choice("uuuv"), f"A{rng.randrange(30)}", T0 + dt.timedelta(minutes=rng.randrange(200))) for _ in range(300)})
    events = [(f"i{k}", rng.choice("uv"), T0 + dt.timedelta(minutes=rng.randrange(220))) for k in range(80)]
    c = spark.createDataFrame([(*x, 1.0) for x in clicks], "user_id string, article_id string, ts timestamp_ntz, read_time double")
    got = {}
    for r in exploded(recent_history(spark.createDataFrame(events, "impression_id string, user_id string, ts timestamp_ntz"), c, 7)).orderBy("h").collect():
        got.setdefault(r["impression_id"], []).append((r["click_ts"], r["article_id"]))
    for i, u, t in events:
        assert got.get(i, []) == sorted(((ts, a) for w, a, ts in clicks if w == u and ts < t), reverse=True)[:7]


def test_sessions_count_strictly_earlier(spark):
    rows = [("a", "u", 1, day(0), ["x"]), ("b", "u", 1, day(1), ["x", "y"]), ("c", "u", 1, day(1), []), ("d", "u", 1, day(2), None), ("e", "u", None, day(2), ["x"]), ("f", None, 1, day(2), ["x"]), ("g", "u", 2, day(2), [])]
    df = spark.createDataFrame(rows, "impression_id string, user_id string, session_id long, ts timestamp_ntz, clicked array<string>")
    assert {r[0]: (r[1], r[2]) for r in features.session_features(df).collect()} == {"a": (1, 0), "b": (2, 1), "c": (2, 1), "d": (4, 3), "e": (0, 0), "f": (0, 0), "g": (1, 0)}


def test_history_features(spark):
    h = spark.createDataFrame([("i", "u", day(3), [(2, day(0), "A", 10.0), (1, day(3), "B", None)]), ("j", "u", day(1), [])], "impression_id string, user_id string, ts timestamp_ntz, hist array<struct<no:long,ts:timestamp_ntz,article_id:string,read_time:double>>")
    r = {x["impression_id"]: x for x in features.history_features(h).collect()}
    assert r["i"]["hist_click_count"] == 2 and r["i"]["hist_recency_weighted_count"] == pytest.approx(1.5) and r["i"]["hist_avg_dwell_seconds"] == 10.0
    assert r["j"]["hist_click_count"] == 0 and r["j"]["hist_avg_dwell_seconds"] == 0.0
    a = spark.createDataFrame([("A", "x"), ("B", None)], "article_id string, category string")
    assert [(c["category"], c["n"]) for c in features.category_counts(h, a).collect()] == [("x", 1)]


def test_leaked_history(spark):
    h = spark.createDataFrame([("i", "u", day(3), [(1, day(0), "A", 1.0)])], "impression_id string, user_id string, ts timestamp_ntz, hist array<struct<no:long,ts:timestamp_ntz,article_id:string,read_time:double>>")
    imps = spark.createDataFrame([("i", "u", ["B", "C"]), ("j", "u", ["C", "D", "gone"])], "impression_id string, user_id string, clicked array<string>")
    arts = spark.createDataFrame([(x,) for x in "ABCD"], "article_id string")
    assert [x["article_id"] for x in ablation.leaked_history(h, imps, arts).first()["hist"]] == ["A", "D"]


# --- splits, samples, profiles ----------------------------------------------------------------


def test_splits(spark):
    df = spark.createDataFrame([(str(i), day(i)) for i in range(10)] + [("n", None)], "id string, ts timestamp_ntz")
    s = splits.split_by_time(df, "ts", day(5), day(7))
    assert {k: v.count() for k, v in s.items()} == {"train": 6, "val": 2, "test": 2}
    assert {k: v.count() for k, v in splits.split_by_days(df, "ts", 2, 1).items()} == {"train": 7, "val": 2, "test": 1}
    splits.verify_split_integrity([("train", s["train"]), ("val", s["val"]), ("none", df.where("false"))], "id", "ts")
    with pytest.raises(AssertionError, match="share [0-9]+ ids"):
        splits.verify_split_integrity([("train", df), ("val", s["val"])], "id", "ts")
    with pytest.raises(AssertionError, match="begins at .* before"):
        splits.verify_split_integrity([("train", s["test"]), ("val", s["train"])], "id", "ts")


def test_sampling(spark):
    df = spark.createDataFrame([(f"i{k:03}", k) for k in range(300)], "id string, o int").repartition(6)
    n = sampling.dense_numbers(df, "o")
    assert [(r["o"], r["row_no"]) for r in n.orderBy("o").collect()] == [(k, k) for k in range(300)]
    got = [r["o"] for r in sampling.seeded_sample(n, 300, 20).orderBy("draw").collect()]
    assert got == random.Random(42).sample(list(range(300)), 20)
    assert [r["o"] for r in sampling.seeded_sample(n, 300, 1000).orderBy("draw").collect()] == list(range(300))
    assert sampling.hash_sample(df, F.col("id"), 9).count() == 9


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert {(r["column_name"], r["nulls"], r["n_rows"]) for r in profile.null_audit(df).collect()} == {("a", 0, 3), ("b", 1, 3)}
    assert {(r["b"], r["n"]) for r in profile.value_counts(df, "b").collect()} == {(None, 1), ("x", 2)}
    assert profile.numeric_summary(df, "a").first()["median"] == 2.0
    assert profile.schema_difference(df, df.withColumn("a", F.lit("s")).withColumn("c", F.lit(1))) == {"only_a": [], "only_b": ["c"], "types": ["a"]}


# --- sources and sinks ------------------------------------------------------------------------


def test_clean_mind(spark, tmp_path):
    lines = {
        "MINDsmall_train": ["70\tU8\t2/3/2021 7:15:09 AM\tN90 N41\tN66-1 N12-0 N66-0", "71\tU8\t02/03/2021 12:00:01 AM\tN90 N41 N7\tN66-0", "72\tU9\t2/4/2021 11:59:59 PM\t\tN12-1 N66-1"],
        "MINDsmall_dev": ["70\tU8\t2/5/2021 8:00:00 AM\tN3\tN66-0 N12-1"],
    }
    for depth, (archive, rows) in enumerate(lines.items()):
        at = tmp_path.joinpath(archive, *["deeper"] * (2 * depth))
        at.mkdir(parents=True)
        (at / "behaviors.tsv").write_text("".join(f"{x}\n" for x in rows))
        (at / "news.tsv").write_text(f'N90\tsport\trowing\tA 5" pipe in {archive}\tabout pipes\tlink\t\t[]\n')
    t = mind.clean_mind(spark, str(tmp_path), "small")
    assert [(r["article_id"], r["title"], r["entities"], r["published_time"]) for r in t["articles"].collect()] == [("N90", 'A 5" pipe in MINDsmall_train', "|[]", None)]
    b = {r["impression_id"]: (r["timestamp"], r["candidate_article_ids"], r["clicked_article_ids"]) for r in t["behaviors_train"].collect()}
    assert b == {
        "mind_train_70": (dt.datetime(2021, 2, 3, 7, 15, 9), ["N66", "N12", "N66"], ["N66"]),
        "mind_train_71": (dt.datetime(2021, 2, 3, 0, 0, 1), ["N66"], []),
        "mind_train_72": (dt.datetime(2021, 2, 4, 23, 59, 59), ["N12", "N66"], ["N12", "N66"]),
    }
    assert [r["impression_id"] for r in t["behaviors_val"].collect()] == ["mind_val_70"]
    # U8's longest history is that of train; its times come before the first impression of train.
    h = {(r["user_id"], r["article_id"]): r["click_timestamp"].second for r in t["user_history"].collect()}
    assert h == {("U8", "N7"): 0, ("U8", "N41"): 59, ("U8", "N90"): 58, ("U8", "N3"): 59}
    with pytest.raises(FileNotFoundError):
        mind.clean_mind(spark, str(tmp_path / "none"), "small")
    raw = mind.read_tsv(spark, str(tmp_path / "MINDsmall_train/behaviors.tsv"), mind.BEHAVIOR).withColumn("time", mind.parse_time(F.col("time")))
    assert {tuple(r["candidate_article_ids"]) for r in mind.clean_behaviors(raw, "test").where("clicked_article_ids is null").collect()} == {("N66-1", "N12-0", "N66-0"), ("N66-0",), ("N12-1", "N66-1")}


def test_vector_files(spark, tmp_path):
    (tmp_path / "e.vec").write_text("Q7\t0.5\t-1.25\t2\nQ8\t0\t1\t-3e-1\n")
    assert {r["id"]: [round(x, 4) for x in r["vec"]] for r in mind.read_vectors(spark, str(tmp_path / "e.vec"), 3).collect()} == {"Q7": [0.5, -1.25, 2.0], "Q8": [0.0, 1.0, -0.3]}
    docs = spark.createDataFrame([(7, [1.0, 2.0]), (8, None)], "article_id int, some_model array<float>")
    docs.write.parquet(str(tmp_path / "docs.parquet"))
    assert [(r["article_id"], r["vec"]) for r in ebnerd.read_document_vectors(spark, str(tmp_path / "docs.parquet")).collect()] == [("7", [1.0, 2.0])]


def test_clean_ebnerd(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "test").mkdir()
    spark.createDataFrame([(7, "t", "sub", "b", "cat", [1, 2], T0, ["X", "Y"], 0.5, 3, 4)], "article_id int, title string, subtitle string, body string, category_str string, subcategory array<int>, published_time timestamp_ntz, ner_clusters array<string>, sentiment_score double, total_pageviews int, total_inviews int").write.parquet(str(tmp_path / "articles.parquet"))
    spark.createDataFrame([(1, 9, T0, [7, 8], [7])], "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>").write.parquet(str(tmp_path / "train/behaviors.parquet"))
    spark.createDataFrame([(0, 9, T0, [7, 8])], "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>").write.parquet(str(tmp_path / "test/behaviors.parquet"))
    hist = spark.createDataFrame([(9, [7, 7, 7, 8], [day(0), day(0), day(1), day(2)], [1.0, 2.0, None, None])], "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>, read_time_fixed array<double>")
    hist.write.parquet(str(tmp_path / "train/history.parquet"))
    hist.write.parquet(str(tmp_path / "test/history.parquet"))
    t = ebnerd.clean_ebnerd(spark, str(tmp_path))
    a = t["articles"].first()
    assert (a["article_id"], a["abstract"], a["subcategory"], a["entities"]) == ("7", "sub", "1,2", "X|Y")
    assert t["behaviors_train"].first()["clicked_article_ids"] == ["7"] and t["behaviors_test"].first()["clicked_article_ids"] is None and t["behaviors_test"].first()["impression_id"] == "ebnerd_test_0"
    assert sorted((r["article_id"], r["click_timestamp"]) for r in t["user_history"].collect()) == [("7", day(0)), ("7", day(1)), ("8", day(2))]
    assert {(r["article_id"], r["click_timestamp"]): r["read_time"] for r in ebnerd.dwell(hist).collect()} == {("7", day(0)): 2.0, ("7", day(1)): None, ("8", day(2)): None}
    assert sinks.build_feature_store(spark, t, str(tmp_path / "store")) and not sinks.build_feature_store(spark, t, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/user_history.parquet")).count() == 3


def test_schema_checks(spark):
    e = empty_frame(spark, ARTICLES)
    assert assert_schema(e, ARTICLES) is e
    with pytest.raises(ValueError):
        assert_schema(e.drop("body"), ARTICLES)


def test_rank_lists_keep_order_and_repeated_ids(spark, tmp_path):
    rows = [(0, "10", 0, 0.1), (0, "10", 1, 0.9), (1, "2", 0, 0.5), (1, "2", 1, 0.5), (2, "10", 0, 1.0)]
    lines = sinks.rank_lines(spark.createDataFrame(rows, "seq long, raw_impression_id string, pos int, score double"))
    sinks.write_lines(lines, str(tmp_path / "out"))
    sinks.zip_lines(str(tmp_path / "out"), str(tmp_path / "x.zip"), "ebnerd")
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.read("predictions.txt").decode() == "10 [2,1]\n2 [1,2]\n10 [1]\n"
    sinks.write_lines(lines, str(tmp_path / "part"), 1, 2)
    assert "".join(p.read_text() for p in (tmp_path / "part").glob("part-*")) == "2 [1,2]\n"


def test_download_is_done_once(tmp_path):
    for name, content in (("winter", "snow"), ("summer", "sun")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("weather.csv" if name == "winter" else "heat/index.csv", content)
    shared = tmp_path / "unpacked"
    for name in ("winter", "summer", "winter"):
        download.unpack(tmp_path / f"{name}.zip", shared)
    assert (shared / "weather.csv").read_text() == "snow" and (shared / "heat/index.csv").read_text() == "sun"
    (shared / "weather.csv").write_text("changed")
    download.unpack(tmp_path / "winter.zip", shared)
    assert (shared / "weather.csv").read_text() == "changed"
    download.unpack(tmp_path / "winter.zip", shared, force=True)
    assert (shared / "weather.csv").read_text() == "snow"
    got = download.download({"mind": {"small": [(tmp_path / "summer.zip").as_uri()]}}, "mind", "demo", tmp_path / "data")
    assert (got / "summer/heat/index.csv").read_text() == "sun"
    asked = []
    for _ in range(2):
        at = download.fetch_gated("some/set", "part.zip", tmp_path / "gated", run=lambda *a, **k: (asked.append(a), at_once(tmp_path / "gated/part.zip")))
    assert len(asked) == 1 and at.read_text() == "here"
    for config in ({}, {"other": {}}):
        with pytest.raises(ValueError):
            download.download(config, "other", "small", tmp_path)


def at_once(path):
    path.parent.mkdir(exist_ok=True)
    path.write_text("here")


def test_catalogue(spark):
    a = spark.createDataFrame([("A", "second", day(2)), ("A", "first", day(1))], "article_id string, title string, delivered_at timestamp_ntz")
    assert [r["title"] for r in catalogue.first_delivery(a).collect()] == ["first"]
    c = spark.createDataFrame([("u", "A", day(1), None), ("u", "A", day(1), 3.0), ("u", "A", day(2), 1.0), (None, "A", day(1), 1.0)], "user_id string, article_id string, click_timestamp timestamp_ntz, read_time double")
    assert sorted((r["ts"], r["read_time"]) for r in catalogue.clicks(c).collect()) == [(day(1), 3.0), (day(2), 1.0)]
