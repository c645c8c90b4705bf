import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.packing import BestFit, pack
from newsloom.llm.tokens import TOKENIZER, encoder, token_sizes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_best_fit_equals_a_plain_version(sizes, bins):
    fit, got, plain, want = BestFit(20, bins), [], [], []
    for k, s in enumerate(sizes):
        got += fit.add(s, k)
        room = [b for b in plain if b[0] >= s]
        if room:
            least = min(b[0] for b in room)
            b = [b for b in room if b[0] == least][-1]
        else:
            if len(plain) == bins:
                least = min(b[0] for b in plain)
                full = [x for x in plain if x[0] == least][-1]
                plain.remove(full)
                want.append(full[1])
            b = [20, []]
        if b in plain and any(b is x for x in plain):
            plain = [x for x in plain if x is not b]
        b = [b[0] - s, b[1] + [k]]
        if b[0]:
            plain.append(b)
        else:
            want.append(b[1])
    assert got == want
    assert sorted(map(tuple, fit.rest())) == sorted(tuple(b[1]) for b in plain)


@pytest.mark.parametrize(("bucket_bins", "bins"), [(4096, 256), (3, 4), (1, 1)])
def test_packing_is_complete_and_fits(spark, bucket_bins, bins):
    rng = random.Random(3)
    sizes = [(k, rng.choice([0, 1, rng.randrange(1, 60), 130, 250])) for k in range(400)] + [(5, 7), (5, 7), (None, 9)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, n_tokens long, k string")
    kinds = spark.createDataFrame([("s", 50), ("l", 120), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = pack(df, kinds, bins, bucket_bins).collect()
    for kind, cap in (("s", 50), ("l", 120)):
        own = [r for r in rows if r["container_kind"] == kind]
        full = {}
        for r in own:
            if r["container_id"] is None:
                assert r["n_tokens"] == 0
            else:
                full[r["container_id"]] = full.get(r["container_id"], 0) + r["n_tokens"]
        assert max(full.values()) <= cap
        pieces = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["n_tokens"]))
        for doc in {d for d, _ in sizes if d != 5}:
            (size,) = [s for d, s in sizes if d == doc]
            ps = sorted(pieces[doc])
            assert [p for p, _, _ in ps] == list(range(len(ps))) and sum(n for _, _, n in ps) == size
            assert [s for _, s, _ in ps] == [cap * k for k in range(len(ps))] and all(n == cap for _, _, n in ps[:-1])
            assert size > cap or len(ps) == 1
        assert len([r for r in own if r["doc_id"] == 5]) == len([1 for d, _ in sizes if d == 5]) + max(0, -(-[s for d, s in sizes if d == 5][0] // cap) - 1)
        if bins == 256:
            assert sum(full.values()) / (len(full) * cap) > 0.95
    assert {r["container_kind"] for r in rows} == {"s", "l"}
    assert pack(df.limit(0), kinds).count() == pack(df, kinds.limit(0)).count() == 0


def test_token_sizes(spark):
    texts = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "æ " * 9000), (5, "<|endoftext|>")]
    got = {r["doc_id"]: r["n_tokens"] for r in token_sizes(spark.createDataFrame(texts, "doc_id long, text string"), "text", ["doc_id"]).collect()}
    e = encoder(TOKENIZER)
    assert got == {k: len(e.encode_ordinary(t)) if t else 0 for k, t in texts} and got[1] == 4 and got[5] > 1
    assert e.decode(e.encode_ordinary(texts[3][1])) == texts[3][1]
