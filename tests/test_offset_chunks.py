import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators.offset_chunks import chunk_states, heavy_keys, merge_states, number_rows, per_key, prefix_sums

T0 = dt.datetime(2024, 1, 1)


def data(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(600)) if rng.random() > 0.02 else None, rng.randrange(5), "x", 1) for _ in range(n)]


SCHEMA = "k string, ts timestamp_ntz, v long, key string, at int"  # the last two clash with names inside


def brute(rows, gap):
    by = defaultdict(list)
    for k, ts, v, *_ in rows:
        if k is not None:
            by[k].append((ts, v))
    out = {}
    for k, xs in by.items():
        ts = sorted(t for t, _ in xs if t is not None)
        runs = 1 + sum((b - a).total_seconds() > gap for a, b in zip(ts, ts[1:], strict=False))
        out[k] = (len(xs), min(ts, default=None), max(ts, default=None), runs, sum(v for _, v in xs))
    return out


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_merged_states_equal_brute_force(spark, chunk_rows):
    rows = data(700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["key"]: (r["n_rows"], r["first_at"], r["last_at"], r["n_runs"], r["v"]) for r in per_key(df, F.col("k"), F.col("ts"), {"v": F.col("v")}, 300, chunk_rows).collect()}
    assert got == brute(rows, 300)


def test_numbering_is_dense_and_ordered_and_chunks_are_equal(spark):
    df = spark.createDataFrame(data(500, 1), SCHEMA)
    rows = number_rows(df, F.col("k"), F.col("ts"), partitions=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["key"]].append((r["row_no"], r["at"] or T0 - dt.timedelta(1)))
    for xs in by.values():
        xs.sort()
        assert [n for n, _ in xs] == list(range(len(xs)))
        assert [t for _, t in xs] == sorted(t for _, t in xs)
    sizes = defaultdict(int)
    for r in chunk_states(number_rows(df, F.col("k"), F.col("ts"), partitions=7), 60, 50).collect():
        sizes[r["key"], r["_chunk"]] += r["n"]
    hot = [n for (k, _), n in sorted(sizes.items()) if k == "hot"]
    assert set(hot[:-1]) == {50} and hot[-1] <= 50


def test_equal_times_spread_over_partitions(spark):
    df = spark.createDataFrame([("hot", T0, 1)] * 400, "k string, ts timestamp_ntz, v long")
    parts = {r["_part"]: r["n"] for r in chunk_states(number_rows(df, F.col("k"), F.col("ts"), partitions=4), 60, 10_000).collect()}
    assert len(parts) == 4 and max(parts.values()) < 250


def test_prefix_sums(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 1, 5)], "k string, o int, v long")
    got = {(r["k"], r["o"]): r["before"] for r in prefix_sums(df, "k", ["o"], "v").collect()}
    assert all(got["a", i] == sum(j % 3 for j in range(i)) for i in range(50)) and got["b", 1] == 0


def test_empty_and_heavy(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert per_key(empty, F.col("k"), F.col("ts")).count() == 0
    df = spark.createDataFrame([("a", T0, 1)] * 3 + [("b", T0, 1)] * 147, "k string, ts timestamp_ntz, v long")
    states = chunk_states(number_rows(df, F.col("k"), F.col("ts")), 60)
    assert {r["key"] for r in heavy_keys(merge_states(states, 60), 150, 0.02).collect()} == {"a", "b"}
    assert {r["key"] for r in heavy_keys(merge_states(states, 60), 151, 0.02).collect()} == {"b"}
