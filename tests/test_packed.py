import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.operators.packed import MAX_EDGE, forward_backward, lattice, learn_splits, tokens, unpack, viterbi


def by_hand(s):
    out, i = [], 0
    while i < len(s or ""):
        c = s[i]
        if c in "\"'" and (j := s.find(c, i + 1)) > 0:
            item, i = s[i + 1 : j].strip(), j + 1
            if item:
                out.append(item)
        elif re.match(r"[A-Za-z0-9-]", c):
            item = re.match(r"[A-Za-z0-9-]+", s[i:])[0]
            out.append(item)
            i += len(item)
        else:
            i += 1
    return out


CASES = [None, "", "  ", "N1 N2", "N1-0;N2-1", '"N1, 2" N3', "'a'b'c", '""', '" x "', 'N1 "N2', "N1|'N2\"x'|N3", "[N1,N2]", "N1 N2，N3", "-", "N1--1 - N2", "a" * 5000, "æøå N1", '"\n"', "'N1''N2'", '" "x']


def test_unpack_equals_a_scanner(spark):
    df = spark.createDataFrame([(i, s, "N1-0 N2-1", 0) for i, s in enumerate(CASES)], "row_id long, history string, impressions string, place int")
    got = {}
    for r in unpack(df, ["history", "impressions"], "row_id").orderBy("row_id", "item_position").collect():
        got.setdefault((r["row_id"], r["field_name"]), []).append((r["item_position"], r["item"]))
    for i, s in enumerate(CASES):
        assert got.get((i, "history"), []) == list(enumerate(by_hand(s))), s
        assert got[i, "impressions"] == [(0, "N1-0"), (1, "N2-1")]
    assert unpack(df.limit(0), ["history"], "row_id").count() == 0


@pytest.mark.parametrize(("rows", "stretch", "want"), [
    (["red-blue", "red", "blue", "green-red", "green", "blue-green", "red", "blue", "green"] * 30, "red-blue", ["red", "blue"]),
    ([f"N{i % 40}-{i % 2}" for i in range(400)], "N3-1", ["N3-1"]),
])
def test_expectation_maximisation_learns_what_a_joiner_means(spark, rows, stretch, want):
    found = tokens(spark.createDataFrame(list(enumerate(rows)), "row_id long, f string"), ["f"], "row_id")
    assert {r["stretch"]: r["split"] for r in learn_splits(found).collect()}[stretch] == want


def test_splits_shift_positions_where_joiners_may_separate(spark):
    rows = ["red-blue x", "red", "blue", "green-red", "green", "blue-green", "red", "blue", "green"] * 30
    got = unpack(spark.createDataFrame(list(enumerate(rows)), "row_id long, f string"), ["f"], "row_id", exact=False).where("row_id = 0").orderBy("item_position").collect()
    assert [(r["item_position"], r["item"]) for r in got] == [(0, "red"), (1, "blue"), (2, "x")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5), st.floats(0.05, 0.95), st.randoms())
def test_lattice_sums_equal_enumeration(atoms, p_sep, rng):
    edges = [(i, j, v, rng.random() + 0.01) for i, j, v in lattice("-".join(atoms))]
    prob = {(i, j): p for i, j, _, p in edges}
    paths = []
    for cuts in product([0, 1], repeat=len(atoms) - 1):
        ends = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(atoms)]
        w = 1.0
        for i, j in zip(ends, ends[1:], strict=False):
            w *= prob[i, j] * (1 - p_sep) ** (j - i - 1) * (p_sep if i else 1)
        paths.append((w, list(zip(ends, ends[1:], strict=False))))
    total = sum(w for w, _ in paths)
    post, seps = forward_backward([(i, j, p) for i, j, _, p in edges], p_sep)
    for (i, j, _, _), q in zip(edges, post, strict=True):
        assert abs(q - sum(w for w, path in paths if (i, j) in path) / total) < 1e-9
    assert abs(seps - sum(w * (len(path) - 1) for w, path in paths) / total) < 1e-9
    best = max(paths)[1]
    assert viterbi(edges, p_sep) == ["-".join(atoms[i:j]) for i, j in best] or len({round(w, 15) for w, _ in paths}) < len(paths)


def test_long_stretches_have_lattices_in_proportion():
    atoms = [f"v{k}" for k in range(2000)]
    edges = lattice("-".join(atoms))
    assert len(edges) <= MAX_EDGE * 2000 + 1 and (0, 2000, "-".join(atoms)) in edges
    assert {(k, k + 1, v) for k, v in enumerate(atoms)} <= set(edges)
    assert lattice("-") == [(0, 2, "-")]
    values = set(atoms)
    assert viterbi([(i, j, v, 0.01 if v in values else 0.0) for i, j, v in edges], 0.9) == atoms


def test_the_rows_follow_what_was_learned(spark):
    """The same field comes out differently beside columns that teach another meaning of its joiner."""
    joined, apart = [f"N{i % 40}-{i % 2}" for i in range(400)], ["N3", "1", "N5", "0"] * 100 + ["N3-1", "N3-0", "N5-1", "N5-0"] * 5
    for rows, want in ((joined, ["N3-1", "x"]), (apart, ["N3", "1", "x"])):
        df = spark.createDataFrame(list(enumerate(["N3-1 x", *rows])), "row_id long, f string")
        assert [r["item"] for r in unpack(df, ["f"], "row_id").where("row_id = 0").orderBy("item_position").collect()] == want
