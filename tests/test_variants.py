import json

import pytest
from pyspark.sql import functions as F

from newsloom import cli
from newsloom.functions.stem import danish, porter, stemmed
from newsloom.operators import variants


@pytest.mark.parametrize(("word", "stem"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"), ("formaliti", "formal"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is"),
])
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("indtage", "indtag"), ("indtagelse", "indtag"), ("underste", "underst"), ("undersøgelser", "undersøg"), ("husene", "hus"), ("barnets", "barn"), ("venlighed", "ven"), ("by", "by")])
def test_danish(word, stem):
    assert danish(word) == stem


def test_stemmed_arrays(spark):
    assert [r[0] for r in spark.createDataFrame([(["cats", "ponies"],), ([],), (None,)], "w array<string>").select(stemmed(F.col("w"), "en")).collect()] == [["cat", "poni"], [], None]


def test_repeated_query_words_count(spark):
    a = spark.createDataFrame([("A", "budget vote", None), ("B", "sun", None), ("C", "sun sea", None), ("D", None, None)], "article_id string, title string, abstract string")
    given = spark.createDataFrame([("i", ["B", "A", "A"]), ("none", [])], "impression_id string, items array<string>")
    counts = variants.title_terms(given, a, 2)
    assert counts.first()["counts"] == {"budget": 2, "vote": 2}
    c = spark.createDataFrame([("i", 0, "A"), ("i", 1, "B"), ("none", 0, "A")], "impression_id string, pos int, article_id string")
    once = variants.bm25_scores(c, counts.withColumn("counts", F.transform_values("counts", lambda k, v: F.lit(1).cast("long"))), a)
    got = {(r["impression_id"], r["pos"]): r["bm25_score"] for r in variants.bm25_scores(c, counts, a).collect()}
    assert got["i", 0] == pytest.approx(2 * once.where("impression_id = 'i' and pos = 0").first()["bm25_score"]) and got["i", 1] == got["none", 0] == 0.0


def test_labels_and_preview(spark):
    i = spark.createDataFrame([("i", ["A", "B"], ["B"]), ("j", ["A"], None)], "impression_id string, cands array<string>, clicked array<string>")
    assert [r["labels"] for r in variants.labelled(i).orderBy("impression_id").collect()] == [[0, 1], [-1]]
    r = spark.createDataFrame([(1, 0.5, 0.1), (9, 0.2, 0.2)], "h int, x double, y double")
    assert {x["slice"]: x["winner"] for x in variants.recall_preview(r, "h", "x", "y").collect()} == {"overall": "x", "short": "x", "long": "tie"}


def test_command_line(spark, tmp_path):
    assert cli.parser().parse_args(["submission", "--data", "d", "--out", "o", "--start", "5"]).start == 5
    known = cli.core_queries.QUERIES | cli.reference_queries.QUERIES
    assert all(q in known for names in cli.TARGETS.values() for q in names)
    (tmp_path / "c.json").write_text(json.dumps({"mind": {"small": []}}))
    assert cli.read_config(str(tmp_path / "c.json")) == {"mind": {"small": []}}
    with pytest.raises(ValueError):
        cli.build(spark, "other", "small", "r", "s", False)
