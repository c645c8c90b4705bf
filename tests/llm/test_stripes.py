import random
from collections import Counter
from itertools import combinations
from math import log

import pyarrow as pa
import pytest

from newsloom.llm import stripes


def brute(baskets, least, lift):
    sets = [sorted(set(b)) for b in baskets if b]
    n, one, two = len(sets), Counter(x for b in sets for x in b), Counter(p for b in sets for p in combinations(b, 2))
    return {(a, b, k, one[a], one[b]) for (a, b), k in two.items() if k >= least and k * n >= lift * one[a] * one[b]}, n


@pytest.mark.parametrize("stripe", [1_000_000, 20, 1])
def test_equals_brute_force(spark, monkeypatch, stripe):
    monkeypatch.setattr(stripes, "MAX_STRIPE", stripe)
    rng = random.Random(2)
    baskets = [rng.sample(["hot", *(f"x{k}" for k in range(k0, k0 + 4))], rng.randrange(0, 5)) for k0 in (rng.randrange(30) for _ in range(600))] + [["lonely"], []]
    df = spark.createDataFrame([([*b, None, *b[:1]], 1, "x") for b in baskets] + [(None, 1, "x")], "basket array<string>, bid int, item string")
    for least, lift in ((5, 10), (2, 1)):
        want, n = brute(baskets, least, lift)
        rows = stripes.together(df, least, lift, min_llr=0.0).collect()
        assert {(r["article_a"], r["article_b"], r["n_ab"], r["n_a"], r["n_b"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["n_baskets"] == n for r in rows)
    assert want and any(r["article_a"] == "hot" for r in rows)


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([(x,) for x in [["a", "b"]] * 8 + [["a"], ["b"]] + [["c"]] * 90], "basket array<string>")
    (r,) = stripes.together(df, 5, 5).collect()
    h = lambda *ks: sum(k * log(k / sum(ks)) for k in ks if k)
    k = (8, 1, 1, 90)
    want = 2 * (h(*k) - h(k[0] + k[1], k[2] + k[3]) - h(k[0] + k[2], k[1] + k[3]))
    assert r["llr"] == pytest.approx(want) and r["lift"] == pytest.approx(8 * 100 / 81)


def test_no_baskets(spark):
    assert stripes.together(spark.createDataFrame([], "basket array<string>")).count() == 0


@pytest.mark.parametrize("gather", [1, 7, 10**6])
def test_stripes_are_combined_in_the_mapper_and_merged_by_key(monkeypatch, gather):
    monkeypatch.setattr(stripes, "GATHER", gather)
    rng = random.Random(4)
    baskets = [sorted(rng.sample(range(12), rng.randrange(1, 7))) for _ in range(200)]
    want = Counter(p for b in baskets for p in combinations(b, 2))
    tasks = []
    for part in (baskets[:120], baskets[120:]):
        rows = [pa.RecordBatch.from_pydict({"codes": pa.array(x, pa.list_(pa.int64())), "segs": pa.array([[1 + c % 3 for c in b] for b in x], pa.list_(pa.int64()))}) for x in (part[:50], part[50:])]
        made = [r for batch in stripes._make_stripes(iter(rows)) for r in batch.to_pylist()]
        if gather == 10**6:
            assert len({(r["a"], r["seg"]) for r in made}) == len(made)  # one stripe an item and segment and task
        assert all(r["bs"] == sorted(set(r["bs"])) and {b % (1 + r["a"] % 3) for b in r["bs"]} == {r["seg"]} for r in made)
        tasks += made
    tasks.sort(key=lambda r: (r["a"], r["seg"]))
    blocks = [pa.RecordBatch.from_pylist(tasks[i : i + 5]) for i in range(0, len(tasks), 5)]
    merged = [r for batch in stripes._merge_stripes(iter(blocks)) for r in batch.to_pylist()]
    assert len({(r["a"], r["seg"]) for r in merged}) == len(merged)
    assert {(r["a"], b): n for r in merged for b, n in zip(r["bs"], r["ns"], strict=True)} == want


def test_insignificant_pairs_are_left_out(spark):
    df = spark.createDataFrame([(x,) for x in [["a", "b"]] * 3 + [["a"]] * 3 + [["b"]] * 3 + [["c"]] * 9], "basket array<string>")
    assert stripes.together(df, 2, 1).count() == 0 and stripes.together(df, 2, 1, min_llr=0.0).count() == 1
