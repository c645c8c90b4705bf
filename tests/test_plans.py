import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.operators.metrics import top_lists
from newsloom.plans import core_queries, reference_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p6_found"])
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(core_queries.QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["recent_history_top20", "bm25_candidate_scores", "emb_candidate_scores", "feature_table", "impression_metrics", "session_features"])
def test_no_nested_loops_in_news_queries(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(reference_queries.QUERIES[name](spark, DATA)))


def test_scans_read_only_what_is_asked(spark):
    p = plan(reference_queries.QUERIES["session_features"](spark, DATA))
    assert "IsNotNull(clicked_article_ids)" in p
    read = set(re.findall(r"(\w+):", "".join(re.findall(r"ReadSchema: struct<(.*?)$", p, re.M))))
    assert "user_id" in read and not read & {"scroll_percentage", "device_type", "ingested_at"}


def test_semi_joins_move_below_explode(spark):
    b = reference_queries.Base(spark, DATA).t("behaviors").select("impression_id", F.explode("candidate_article_ids").alias("article_id"))
    some = reference_queries.Base(spark, DATA).t("candidate_scores").select("impression_id")
    p = plan(b.join(some, "impression_id", "left_semi"))
    assert p.index("Generate") < p.index("LeftSemi")


def test_top_lists_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("impression_id"), F.col("id").alias("pos"), F.rand(1).alias("score"))
    assert plan(top_lists(df, ["impression_id"], 5)).count("WindowGroupLimit") == 2
