"""The studies' operators against plain versions on small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import session
from newsloom.operators import ablation, bootstrap, metrics, profile, retrieval, sampling, splits, variants
from newsloom.plans import study_queries
from newsloom.sources.sinks import in_input_order

T0 = dt.datetime(2024, 1, 1)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class NoDir:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return NoDir

        @staticmethod
        def getCheckpointDir():
            class Nothing:
                isDefined = staticmethod(lambda: False)

            return Nothing

    class Remote:
        conf, sparkContext = Conf(), NoDir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Remote)
    assert [session.one_machine(m) for m in ("local", "local[8]", "local-cluster[2,1,1024]", "yarn", "k8s://x")] == [True, True, False, False, False]


def test_written_tables_can_be_removed(spark):
    before = list(session._written)
    session._written.clear()
    try:
        df = session.written(spark.range(5))
        assert df.count() == 5 and len(session._written) == 1
        session.release()
        assert not session._written
        with pytest.raises(Exception, match="(?i)not exist|no such|does not"):
            spark.read.parquet(df.inputFiles()[0]).count()
    finally:
        session._written.extend(before)


def test_leaked_vectors_equal_the_mean_of_leaked_histories(spark):
    rng = random.Random(3)
    names = [f"a{k}" for k in range(12)]
    vec = {a: [rng.random(), rng.random()] for a in names[:10]}  # two articles have no vector
    articles = spark.createDataFrame([(a,) for a in names[:11]], "article_id string")  # one isn't in the catalogue
    vectors = spark.createDataFrame(list(vec.items()), "article_id string, vec array<double>")
    imps = [(f"i{k}", rng.choice(["hot"] * 4 + ["u", None]), T0, [rng.choice(names) for _ in range(rng.randrange(4))]) for k in range(60)]
    i = spark.createDataFrame(imps, "impression_id string, user_id string, ts timestamp_ntz, clicked array<string>")
    hist = {k[0]: [rng.choice(names[:10]) for _ in range(rng.randrange(3))] for k in imps}
    h = i.drop("clicked").join(spark.createDataFrame([(k, [(0, T0, a, None) for a in x]) for k, x in hist.items()], "impression_id string, hist array<struct<no:long,ts:timestamp_ntz,article_id:string,read_time:double>>"), "impression_id")
    got = {r["impression_id"]: r["vec"] for r in ablation.leaked_user_vectors(h, i, articles, vectors, 2).collect()}
    lists = {r["impression_id"]: [x["article_id"] for x in r["hist"]] for r in ablation.leaked_history(h, i, articles).collect()}
    want = {k: np.mean([vec[a] for a in x if a in vec], axis=0) for k, x in lists.items() if any(a in vec for a in x)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(list(want[k])) for k in want)


def test_weight_grid_equals_the_metric(spark):
    rng = random.Random(4)
    rows = [(f"i{k % 17}", k, int(rng.random() < 0.3), rng.choice([0.0, 0.5, rng.random()]), rng.choice([0.0, 1.0, rng.random()])) for k in range(150)] + [("one", 1, 1, 0.5, 0.5)]
    both = spark.createDataFrame(rows, "impression_id string, pos int, label int, bm25 double, emb double")
    got = {r["alpha"]: (r["auc"], r["n"]) for r in retrieval.alpha_grid(both).collect()}
    assert sorted(got) == retrieval.ALPHAS
    for a in (0.0, 0.35, 1.0):
        scored = both.withColumn("score", F.round(retrieval.hybrid(F.col("bm25"), F.col("emb"), a), 9))
        want = metrics.impression_auc(scored, ["impression_id"]).agg(F.avg("auc"), F.count("auc")).first()
        assert got[a] == (pytest.approx(want[0]), want[1])
    assert retrieval.alpha_grid(both.limit(0)).count() == 0


def test_metrics_in_one_pass(spark):
    rows = [("i", 0, 0.9, 0), ("i", 1, 0.9, 1), ("i", 2, 0.1, 0), ("j", 0, 0.2, 1), ("j", 1, 0.3, 1), ("k", 0, 0.1, 0)]
    df = spark.createDataFrame(rows, "impression_id string, pos int, score double, label int")
    (r,) = metrics.impression_metrics(df, ["impression_id"]).collect()
    assert (r["impression_id"], r["auc"], r["mrr"]) == ("i", 0.75, 0.5) and r["ndcg5"] == pytest.approx(1 / np.log2(3))
    assert metrics.impression_metrics(df, ["impression_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_packed_labels(spark):
    df = spark.createDataFrame([(["N1-0", "N2-1", "N3", "x-y-1", "N4-2", ""],)], "s array<string>")
    r = df.select(*variants.parse_shown(F.col("s"))).first()
    assert r[0] == ["N1", "N2", "N3", "x-y", "N4-2", ""] and r[1] == [0, 1, -1, 1, -1, -1]
    i = spark.createDataFrame([(["a", "b", "a"], ["a"]), (["c"], None)], "cands array<string>, clicked array<string>")
    assert {tuple(x) for x in variants.label_popularity(variants.labelled(i)).collect()} == {("a", 2)}


def test_samples(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    fit = df.where("k % 2 = 0")
    got = sampling.two_stage_sample(df, fit, "k", 30).collect()
    assert len({r["k"] for r in got}) == len(got) <= 30 and all(int(r["k"]) % 2 == 0 for r in got)
    assert sampling.two_stage_sample(df, df, "k", 30).count() == 30 and sampling.two_stage_sample(df.limit(0), fit, "k", 30).count() == 0
    assert sorted(r["row_no"] for r in sampling.dense_numbers(df.repartition(7), "k").collect()) == list(range(100))


def test_extended_vectors(spark):
    a, b = (spark.createDataFrame(x, "article_id string, vec array<double>") for x in ([("a", [1.0])], [("a", [9.0]), ("b", [2.0])]))
    assert {(r["article_id"], r["vec"][0], r["added"]) for r in retrieval.extend_vectors(a, b).collect()} == {("a", 1.0, False), ("b", 2.0, True)}


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (3, 2.0)], "a int, b double")
    got = {r["column_name"]: tuple(r)[1:] for r in profile.describe(df, ["a", "b"]).collect()}
    assert got["a"] == (2, 2.0, pytest.approx(2**0.5), 1.0, 3.0) and got["b"] == (1, 2.0, None, 2.0, 2.0)
    assert [tuple(r) for r in profile.table_metadata({"t": df}).collect()] == [("t", 2, 2)]
    s = spark.createDataFrame([("train", T0), ("val", T0)], "s string, t timestamp_ntz")
    assert splits.strict_order(s, "s", "t", "train", "val").first()["in_order"] is False


def test_input_order_and_ranges(spark, tmp_path):
    rows = [(f"r{k}", "t" if k % 3 else None, T0 - dt.timedelta(k), 1, ["x", "y"], None if k % 2 else []) for k in range(20)]
    schema = "raw_impression_id string, user_id string, timestamp timestamp_ntz, session_id long, candidate_article_ids array<string>, clicked_article_ids array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "behaviors.parquet"))
    t = in_input_order(spark.read.parquet(str(tmp_path / "behaviors.parquet")))
    assert [r["raw_impression_id"] for r in t.where("_row >= 5 and _row < 8").orderBy("_row").collect()] == ["r5", "r6", "r7"]
    seqs = {r["seq"]: r["raw_impression_id"] for r in study_queries.unlabelled_rows(spark, str(tmp_path)).collect()}
    assert seqs == {k: f"r{2 * k + 1}" for k in range(10)}
    assert {r["seq"] for r in study_queries.unlabelled_rows(spark, str(tmp_path), 3, 6).collect()} == {3, 4, 5}


def test_paired_intervals_use_common_rows(spark):
    a, b = (spark.createDataFrame([("m", f"i{k}", float(k % 3) + d) for k in range(20 + n)], "metric string, impression_id string, auc double") for d, n in ((0.0, 3), (0.5, 0)))
    (r,) = bootstrap.paired_grouped_ci(a, b, ["metric"], "impression_id", "auc").collect()
    assert r["n"] == 20 and r["mean"] == pytest.approx(0.5) and r["significant"]
