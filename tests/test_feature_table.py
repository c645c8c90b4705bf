import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.operators import feature_table as ft
from newsloom.operators.skew import hot_keys, salted_lookup

T0 = dt.datetime(2024, 1, 1)


def test_cells_and_table(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice(["x", "y", None]), T0 + dt.timedelta(minutes=rng.randrange(99)) if rng.random() > 0.1 else None, rng.choice([None, -1.0, 2.5, 1e9, float("nan"), 4.0]), 7) for _ in range(400)]
    df = spark.createDataFrame(rows, "u string, k string, t timestamp_ntz, a double, n int")
    cells = ft.feature_cells(df, F.col("u"), F.col("k"), F.col("t"), F.col("a"))
    want = defaultdict(lambda: [0, None, 0.0])
    for u, k, t, a, _ in rows:
        if u and k:
            c = want[u, k]
            c[0] += 1
            c[1] = max((x for x in (c[1], t) if x), default=None)
            c[2] += a if a in (2.5, 4.0) else 0
    assert {(r["entity"], r["kind"]): [r["n"], r["last_at"], r["total"]] for r in cells.collect()} == dict(want)
    table = {r["entity"]: r["features"] for r in ft.feature_table(cells, ["w", "x", "y"]).collect()}
    assert [f["kind"] for f in table["hot"]] == ["w", "x", "y"] and table["hot"][0]["n"] == 0 and table["hot"][0]["last_at"] is None
    assert [f["n"] for f in table["a"]] == [0, want["a", "x"][0], want["a", "y"][0]]
    assert ft.wide(ft.feature_table(cells, ["x"]), ["x"]).columns == ["entity", "n_x", "last_x", "total_x"]
    assert ft.feature_table(ft.feature_cells(df.limit(0), F.col("u"), F.col("k"), F.col("t"), F.col("a")), ["x"]).count() == 0


def test_type_list_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "k string")
    assert ft.type_list(df, "k") == ["a", "b"]
    monkeypatch.setattr(ft, "MAX_TYPES", 1)
    with pytest.raises(ValueError):
        ft.type_list(df, "k")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_join(spark, how):
    facts = spark.createDataFrame([(k, i, "s") for i, k in enumerate(["hot"] * 300 + ["a", "b", None, "z"])], "k string, i int, s string")
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 3), (None, 4)], "k string, v int")
    assert hot_keys(facts, F.col("k"), 0.5) == [("hot", 300 / 303)]
    got = sorted(map(str, salted_lookup(facts, dim, "k", how, hot=[("hot", 0.9)]).collect()))
    assert got == sorted(map(str, facts.join(dim, "k", how).collect()))
