"""Queries over small tables, for what their SQL leaves out."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import catalogue, retrieval
from newsloom.plans import core_queries, reference_queries

T0 = dt.datetime(2024, 1, 1)


def folder(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_feature_table_has_every_user_and_type(spark, tmp_path):
    t1 = T0 + dt.timedelta(hours=1)
    d = folder(
        spark, tmp_path,
        behaviors=([("i1", "u1", T0, ["a", "b"], 2.5), ("i2", "u1", t1, ["a"], 4.0), ("i3", "idle", t1, [], 9.0), ("i4", "test", t1, None, None), ("i5", None, t1, ["a"], 1.0)], "impression_id string, user_id string, timestamp timestamp_ntz, clicked_article_ids array<string>, read_time double"),
        articles=([("a", "x"), ("b", "y"), ("c", "z")], "article_id string, subcategory string"),
    )
    got = {r["user_id"]: r for r in core_queries.p5_feature_table(spark, d).collect()}
    assert set(got) == {"u1", "idle", "test"}
    assert [got["u1"][c] for c in ("clicks", "last_at", "total")] == ["2,1,0", [t1, T0, None], [6.5, 2.5, 0.0]]
    for u in ("idle", "test"):
        assert [got[u][c] for c in ("clicks", "last_click", "read_time", "last_at", "total")] == ["0,0,0", None, 0.0, [None] * 3, [0.0] * 3]


def test_every_article_has_its_vector(spark):
    articles = spark.createDataFrame([(f"N{i}",) for i in range(30)], "article_id string")
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = {r["article_id"]: r["vec"] for r in catalogue.article_vectors(articles, vectors).collect()}
    assert set(got) == {f"N{i}" for i in range(30)} and got["N7"] == got["N3"] != got["N6"]


def test_missing_vectors_are_skipped_and_score_0(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "article_id string, vec array<double>")
    history = spark.createDataFrame([("i1", ["none", "a"]), ("i2", ["none"])], "impression_id string, items array<string>").select("impression_id", F.transform("items", lambda x: F.struct(x.alias("article_id"))).alias("hist"))
    users = retrieval.user_vectors(history, vectors, 2)
    assert {r["impression_id"]: r["vec"] for r in users.collect()} == {"i1": [1.0, 0.0]}
    cands = spark.createDataFrame([("i1", 0, "a"), ("i1", 1, "none"), ("i1", 2, "b")], "impression_id string, pos int, article_id string")
    assert [r["score"] for r in retrieval.score_candidates(cands, users, vectors).orderBy("pos").collect()] == [1.0, 0.0, 0.0]


def test_mind_keeps_the_ends_of_months_and_drops_impossible_dates(spark, tmp_path):
    days = ["1/29/2024", "01/30/2024", "12/31/2023", "2/29/2024", "2/29/2023", "2/30/2024", "4/31/2024", "1/32/2024", "13/1/2024", "1/1/0000"]
    lines = [(i, "train", f"{i}\tU{i}\t{t} 11:59:59 PM\tN1 N2\tN3-1 N4-0") for i, t in enumerate(days)]
    d = folder(spark, tmp_path, behavior_lines=(lines, "line_id long, split string, line string"))
    kept = {r["impression_id"]: r["ts"] for r in reference_queries.mind_clean_behaviors(spark, d).collect()}
    assert kept == {f"mind_train_{i}": dt.datetime(*x, 23, 59, 59) for i, x in enumerate([(2024, 1, 29), (2024, 1, 30), (2023, 12, 31), (2024, 2, 29)])}
    h = {(r["user_id"], r["article_id"]): r["click_timestamp"] for r in reference_queries.mind_synthetic_history(spark, d).collect()}
    assert h == {(f"U{i}", a): dt.datetime(2023, 12, 31, 23, 59, s) for i in range(4) for a, s in (("N1", 57), ("N2", 58))}


def test_user_vectors_come_out_with_all_dimensions(spark, tmp_path):
    d = folder(
        spark, tmp_path,
        articles=([("N0", "t", T0)], "article_id string, title string, delivered_at timestamp_ntz"),
        behaviors=([("mind_val_1", "1", "mind", "u", T0 + dt.timedelta(days=1), ["N0"], ["N0"], "s", 1.0)], "impression_id string, raw_impression_id string, dataset string, user_id string, timestamp timestamp_ntz, candidate_article_ids array<string>, clicked_article_ids array<string>, session_id string, read_time double"),
        click_log=([("u", "N0", T0, 1.0)], "user_id string, article_id string, click_timestamp timestamp_ntz, read_time double"),
        embeddings=([(0, [float(i) for i in range(64)])], "vec_id long, embedding array<float>"),
    )
    got = {r["dim"]: r["x"] for r in reference_queries.emb_user_vectors(spark, d).collect()}
    length = sum(i * i for i in range(64)) ** 0.5
    assert got == {i: round(i / length, 6) for i in range(64)}


def test_the_history_itself_comes_out(spark, tmp_path):
    at = [T0 + dt.timedelta(days=i) for i in range(4)]
    d = folder(
        spark, tmp_path,
        behaviors=([("i1", "u", at[2], ["c"]), ("i2", "u", at[1], ["c"])], "impression_id string, user_id string, timestamp timestamp_ntz, clicked_article_ids array<string>"),
        user_history=([(1, "u", at[0], at[0], ["a"]), (2, "u", at[1], at[1], ["a", "b"]), (3, "u", at[1], at[3], ["a", "c"])], "history_id long, user_id string, as_of timestamp_ntz, recorded_at timestamp_ntz, history array<string>"),
    )
    got = {r["impression_id"]: (r["history_id"], r["history"]) for r in core_queries.p3_history_at_click(spark, d).collect()}
    assert got == {"i1": (2, ["a", "b"]), "i2": (1, ["a"])}
