import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import topn


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, float("-inf")))
    return {(g, k + 1, i, s) for g, items in best.items() for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize(("least", "broadcast"), [(10_000, 10**6), (500, 10**6), (20, 10**6), (20, 0)])
def test_equals_brute_force(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(topn, "MIN_HEAVY", least)
    monkeypatch.setattr(topn, "BROADCAST_BYTES", broadcast)
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([f"i{rng.randrange(60)}", None, "i1"]), rng.choice([None, float("nan"), 1.0, 2.0, rng.random()])) for _ in range(900)] + [("hot", f"i{k}", 2.0) for k in range(300)] + [("few", "x", 1.0), ("none", "x", None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "g string, i string, s double, place int, item string").repartition(6)
    got = {(r["group"], r["place"], r["item"], r["score"]) for r in topn.top_n(df, "g", "i", "s", 5).collect()}
    assert got == brute(rows, 5)
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0


def test_heavy_groups_are_counted_exactly(spark, monkeypatch):
    df = spark.createDataFrame([("hot", k) for k in range(50)] + [("mid", k) for k in range(20)] + [(None, k) for k in range(30)], "g string, k int")
    assert topn.heavy_groups(df, "g").count() == 0
    monkeypatch.setattr(topn, "MIN_HEAVY", 20)
    assert {r["group"] for r in topn.heavy_groups(df, "g").collect()} == {"hot", "mid"}


def test_a_long_list_of_heavy_groups_makes_no_hot_task(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topn, "MIN_HEAVY", 20)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 < 4, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("group"), F.col("id").cast("string").alias("item"), (F.col("id") * 1.0).alias("score"))
        sizes = [r["count"] for r in topn._marked(df, topn.heavy_groups(df, "group")).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / 16, sorted(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
