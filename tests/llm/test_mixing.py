import random

import pytest

from newsloom.llm import mixing


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(5)
    rows = [("big", k, rng.randrange(1, 40)) for k in range(900)] + [("mid", k, rng.randrange(0, 40)) for k in range(300)] + [("small", k, 10) for k in range(20)] + [("other", 1, 5), (None, 2, 5), ("empty", 3, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "source string, doc_id long, n_tokens long, key string")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 6), ("missing", 0.1, 2), ("empty", 0.05, 1), ("void", None, 1), ("never", 0.2, 0)]


@pytest.mark.parametrize("range_docs", [50_000, 10])
def test_shares_caps_and_cuts(spark, sizes, monkeypatch, range_docs):
    monkeypatch.setattr(mixing, "RANGE_DOCS", range_docs)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    plan = mixing.budgets(sizes, targets)
    mixed = mixing.mix(sizes, plan).collect()
    by = {p["source"]: p for p in plan}
    assert set(by) == {"big", "mid", "small", "missing", "empty"}
    for s in ("big", "mid", "small"):
        own = [r for r in mixed if r["source"] == s]
        given = sum(r["n_tokens"] for r in own)
        assert abs(given - by[s]["budget"]) <= 20
        uses = {}
        for r in own:
            uses.setdefault(r["doc_id"], []).append(r["epoch"])
        assert all(sorted(e) == list(range(1, len(e) + 1)) and len(e) <= by[s]["max_repeats"] for e in uses.values())
        assert max(map(len, uses.values())) - min([len(uses.get(k, [])) for k in range(by[s]["docs"])]) <= 1
    assert {r["source"] for r in mixed} <= {"big", "mid", "small"}
    report = {r["source"]: r for r in mixing.shares(mixing.mix(sizes, plan), plan).collect()}
    assert report["missing"]["actual_share"] == 0 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert report["big"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.01)
    again = mixing.mix(sizes.repartition(7), plan).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))


def test_given_total_and_errors(spark, sizes):
    targets = spark.createDataFrame(TARGETS[:2], "source string, target_share double, max_repeats int")
    assert sum(p["budget"] for p in mixing.budgets(sizes, targets, 1000)) == 800
    with pytest.raises(ValueError):
        mixing.budgets(sizes, targets.unionAll(targets))
    none = mixing.budgets(sizes.limit(0), targets)
    assert mixing.mix(sizes.limit(0), none).count() == 0
