import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import truncation as t

SUBJECTS = ["The council", "Two researchers", "The orchestra", "Parents", "Local traders", "The ministry", "An audit", "The coach"]
VERBS = ["approved", "delayed", "measured", "welcomed", "rejected", "defended", "renamed", "postponed"]
OBJECTS = ["the budget", "a library", "the harbour plan", "one festival", "the railway line", "a bakery", "the film prize", "its concert"]
ENDS = ["on Friday", "before the summer break", "for the third time", "with help from volunteers", "despite a warning", "in March"]


def story(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}{rng.choice('...?!')}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        text, bad = story(rng, rng.randrange(2, 12)), False
        u = rng.random()
        if u < 0.08 and len(text) > 210:
            text, bad = text[:200].rstrip(), True
        elif u < 0.11:
            text, bad = text.rpartition(" ")[0][: rng.randrange(60, max(61, len(text) - 20))] + rng.choice(["…", " [...]", ""]), True
        elif u < 0.2:
            text += rng.choice(["\n(Photo: Ann Lee)", "\nTags: budget, bakery", "\nBy Ann Lee, York", "\nUpdated 3.4. 10:20"])
        elif u < 0.25:
            text += " And that was only the first half …"
        elif u < 0.35:
            text = story(rng, 1)[:-1]
        rows.append((k, text, "wire" if k % 3 else "post", bad and not t._DONE.search(text)))
    rows += [(9000, None, "wire", False), (9001, "", None, False), (9002, " \n", "wire", False), (9003, rows[0][1], None, rows[0][3])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, bad boolean")


def test_held_out_accuracy(spark, docs):
    train = docs.where("doc_id % 2 = 0")
    judged = t.verdicts(t.score(docs.withColumn("score", F.lit("x")), "doc_id", "text", "source", t.fit(train, "doc_id", "text", "source"))).join(docs.select("doc_id", "bad"), "doc_id").where("doc_id % 2 = 1 or doc_id >= 9000").collect()
    hit = sum(r["truncated"] and r["bad"] for r in judged)
    assert hit / sum(r["bad"] for r in judged) > 0.9 and hit / sum(r["truncated"] for r in judged) > 0.9
    assert not any(r["truncated"] for r in judged if 9000 <= r["doc_id"] <= 9002)


def test_copies_share_a_verdict_and_rates(spark):
    rows = [(1, "a", 5, 5, 0.9), (2, "b", 5, 5, 0.1), (3, "b", 6, 6, 0.2), (4, None, 7, 7, 0.8), (4, None, 7, 7, 0.8)]
    judged = t.verdicts(spark.createDataFrame(rows, "doc_id long, source string, h1 long, h2 long, score double"))
    assert sorted((r["doc_id"], r["truncated"]) for r in judged.collect()) == [(1, True), (2, True), (3, False), (4, True), (4, True)]
    assert {r["source"]: (r["docs"], r["truncated"], r["rate"]) for r in t.truncation_rates(judged).collect()} == {"a": (1, 1, 1.0), "b": (2, 1, 0.5), None: (2, 2, 1.0)}


def test_cuts_and_intact():
    rng = random.Random(1)
    text = story(rng, 9)
    assert t.intact(text) and not t.intact(text[:-1]) and not t.intact("Short.") and not t.intact(text + " ...")
    for at_limit in (True, False):
        cuts = [c for _ in range(60) if (c := t.cut(text, "s", {"s": [10]}, rng, at_limit))]
        assert cuts and all(len(c) < len(text) for c in cuts)
        assert all(text.startswith(t._MARK.sub("", c).rstrip("\ufffd")) for c in cuts)


def test_limits_and_enders(spark, docs):
    facts = t.corpus_facts(docs, "text", "source")
    assert 200 // t.STEP in facts.limits["wire"] and facts.enders["break"] == 3 and "the" not in facts.enders


def test_announced_lengths():
    assert [t.announced("x" * 100, n) for n in (None, float("nan"), 100, 99, 105, 140, 300)] == ["none", "none", "same", "less", "bit", "more", "far"]


def test_long_texts_are_read_to_their_end():
    corpus = t.Corpus({"break": 3}, {})
    long = story(random.Random(2), 20_000)
    assert len(long) > 1_000_000
    whole, cut_off = t.features(long, "s", corpus), t.features(long[:-9], "s", corpus)
    assert whole != cut_off and len(set(whole)) == len(whole)


def test_empty(spark, docs):
    none = docs.limit(0)
    assert t.verdicts(t.score(none, "doc_id", "text", "source", t.fit(none, "doc_id", "text", "source"))).count() == 0
