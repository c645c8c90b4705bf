import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.operators import bitemporal
from newsloom.operators.bitemporal import Sweep, bitemporal_join

T0 = dt.datetime(2024, 1, 1)
at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)


def brute(events, versions):
    out = []
    for eid, u, v, r in events:
        if None in (u, v, r):
            continue
        fit = [(a, rec, i) for i, w, a, rec in versions if None not in (w, a, rec, i) and w == u and a < v and rec <= r]
        if fit:
            out.append((eid, max(fit)[2]))
    return sorted(out)


def run(spark, events, versions, cell):
    e = spark.createDataFrame([(i, u, at(v), at(r), "x", 0) for i, u, v, r in events], "eid long, u string, v timestamp_ntz, r timestamp_ntz, entity string, cell int")
    n = spark.createDataFrame([(i, u, at(a), at(r), "x") for i, u, a, r in versions], "vid long, u string, a timestamp_ntz, rec timestamp_ntz, level string")
    j = bitemporal_join(e, n, entity="u", valid="v", known="r", keep=["eid"], version_entity="u", as_of="a", recorded="rec", version_id="vid", rows_per_cell=cell)
    return sorted((x["eid"], x["version_id"]) for x in j.collect())


@pytest.mark.parametrize(("cell", "spread", "seed"), [(2, 0, 1), (3, 40, 2), (5, 0, 3), (1000, 25, 4), (2, 200, 5)])
def test_equals_brute_force(spark, cell, spread, seed):
    rng = random.Random(seed)
    user = lambda: rng.choice(["hot"] * 5 + ["a", "b", "c"])
    versions = [(i, user(), a := rng.randrange(300), a + rng.choice([0, 1, 3, 200, -5])) for i in range(150)]
    events = [(i, user(), v := rng.randrange(-10, 330), v + (rng.randint(-spread, spread) if spread else 0)) for i in range(200)]
    assert run(spark, events, versions, cell) == brute(events, versions)


def test_nulls_ties_empty(spark):
    versions = [(1, "a", 0, 0), (2, "a", 0, 0), (3, "a", 0, 5), (4, None, 0, 0), (5, "a", None, 0), (6, "b", 0, None)]
    events = [(1, "a", 1, 1), (2, "a", 5, 5), (3, "a", 0, 0), (4, None, 9, 9), (5, "a", None, 9), (6, "b", 9, 9), (7, "a", 1, 1)]
    assert run(spark, events, versions, 2) == brute(events, versions) == [(1, 2), (2, 3), (7, 2)]
    assert run(spark, [], versions, 2) == run(spark, events, [], 2) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_rectangles_are_disjoint_and_right(pairs):
    vs = sorted((r, a, i) for i, (a, r) in enumerate(pairs))
    s, rects = Sweep(), []
    for r, a, i in vs:
        if x := s.add(a, r, i):
            rects.append(x)
    rects += s.rest()
    assert len(rects) <= 2 * len(pairs) + 1
    for v in range(14):
        for r in range(14):
            hit = [i for lo, hi, rl, rh, i in rects if lo < v <= hi and rl <= r < rh]
            want = max(((a, rec, i) for rec, a, i in vs if a < v and rec <= r), default=None)
            assert hit == ([want[2]] if want else [])


N = 100_000
LOADS = {
    "recorded in time": lambda c: c + 1,
    "one bulk load": lambda c: F.lit(N),
    "loads of thousands": lambda c: (F.floor(c / 5000) + 1) * 5000,
    "backwards": lambda c: 2 * N - c,
}


@pytest.mark.parametrize("load", sorted(LOADS))
def test_no_cell_is_large_whatever_was_recorded_when(spark, monkeypatch, load):
    """10^5 versions of one entity, and outlier events that know far more or far less than their time."""
    seen, plain = [], bitemporal.rectangles
    monkeypatch.setattr(bitemporal, "rectangles", lambda cells: seen.append(cells) or plain(cells))
    minute = lambda c: F.timestamp_add("SECOND", c.cast("long"), F.lit(T0).cast("timestamp_ntz"))
    i = F.col("id")
    versions = spark.range(N).select(F.lit("hot").alias("u"), minute(i).alias("a"), minute(LOADS[load](i)).alias("rec"), i.alias("vid"))
    events = spark.range(0, 2 * N, 97).select(i.alias("eid"), F.when(i % 5 == 0, "other").otherwise("hot").alias("u"), minute(i).alias("v"), minute(F.when(i % 11 == 0, 10**8).when(i % 13 == 0, 0).otherwise(i)).alias("r"))
    got = {r["eid"]: r["version_id"] for r in bitemporal_join(events, versions, entity="u", valid="v", known="r", keep=["eid"], version_entity="u", as_of="a", recorded="rec", version_id="vid").collect()}
    rec = {r["vid"]: r["s"] for r in versions.select("vid", F.timestamp_diff("SECOND", F.lit(T0).cast("timestamp_ntz"), F.col("rec")).alias("s")).collect()}
    order = [rec[k] for k in range(N)]
    want = {}
    for e in range(0, 2 * N, 97):
        r = 10**8 if e % 11 == 0 else 0 if e % 13 == 0 else e
        if e % 5:
            k = next((k for k in range(min(e, N) - 1, -1, -1) if order[k] <= r), None)
            if k is not None:
                want[e] = k
    assert got == want
    for cells in seen:
        assert (cells.groupBy("entity", "cell").count().agg(F.max("count")).first()[0] or 0) <= bitemporal.ROWS_PER_CELL
