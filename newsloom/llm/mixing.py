"""Mixing sources to target weights, by tokens.

The budget is the largest total at which every present source can give its share
with at most `max_repeats` passes (or a smaller given total). Documents get
hash-random keys; each source is cut into equal ranges of the key, as many as its
size calls for; token counts are summed per range, prefix-summed over the ranges
and then within each, and the last pass of a source is cut at its exact budget: a
document is in if more than half of it lies before the cut.

Defined results: sources without a target, or with a null or non-positive share
or repeat cap, are not mixed; a target without documents gives nothing, and its
row in the report shows 0; documents without tokens are kept in every full pass;
a null doc_id counts as any other; repeated rows count each, equal keys are ordered
by doc_id and size; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_DOCS = 50_000
MAX_TARGETS = 10_000


def target_list(targets: DataFrame) -> list:
    """The targets that count; more than MAX_TARGETS, or one source twice, is an error."""
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS or len({r["source"] for r in listed}) < len(listed):
        raise ValueError("targets must be distinct sources, at most %d" % MAX_TARGETS)
    return listed


def of_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents of the sources that have a target."""
    keys = docs.sparkSession.createDataFrame([(r["source"],) for r in target_list(targets)], "source string")
    return docs.join(F.broadcast(keys), "source", "left_semi")  # at most MAX_TARGETS rows


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per target: available documents and tokens, budget, full passes and the rest to be cut from one more pass."""
    listed = target_list(targets)
    have = {r["source"]: r for r in of_targets(sizes, targets).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    present = [r for r in listed if r["source"] in have and have[r["source"]]["tokens"] > 0]
    most = min((have[r["source"]]["tokens"] * r["max_repeats"] / r["target_share"] for r in present), default=0)
    total = min(most, total_tokens) if total_tokens else most
    out = []
    for r in listed:
        docs, tokens = (have[r["source"]]["docs"], have[r["source"]]["tokens"]) if r["source"] in have else (0, 0)
        want = min(round(total * r["target_share"]), tokens * r["max_repeats"])
        passes, rest = divmod(want, tokens) if tokens else (0, 0)
        out.append({"source": r["source"], "target_share": r["target_share"], "max_repeats": r["max_repeats"], "docs": docs, "tokens": tokens, "budget": want, "passes": passes, "rest": rest, "bits": max(0, ceil(log2(max(1, docs / RANGE_DOCS))))})
    return out


def mix(sizes: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """`source`, `doc_id`, `epoch` (from 1), `n_tokens`, `mix_key` (random order of the mixture) of every use of a document."""
    spark = sizes.sparkSession
    spec = spark.createDataFrame([(p["source"], p["passes"], p["rest"], p["bits"]) for p in plan], "source string, passes long, rest long, bits int")
    docs = sizes.select("source", "doc_id", "n_tokens").join(F.broadcast(spec), "source")  # at most MAX_TARGETS rows
    docs = docs.withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)).withColumn("range", F.expr("shiftright(key, 63 - bits)"))
    sums = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("end", F.sum("n_tokens").over(local)).join(offsets, ["source", "range"]).withColumn("end", F.col("end") + F.col("offset"))
    in_rest = (F.col("rest") > 0) & (2 * F.col("end") - F.col("n_tokens") <= 2 * F.col("rest"))
    uses = placed.withColumn("uses", F.col("passes") + in_rest.cast("long")).where("uses > 0")
    return uses.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("epoch"), "n_tokens").withColumn("mix_key", F.xxhash64("doc_id", "epoch", F.lit(seed + 1)))


def shares(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """The report: per target its share wanted and given, tokens given, tokens there, and the most uses of one document."""
    spark = mixed.sparkSession
    spec = spark.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["tokens"]) for p in plan], "source string, target_share double, max_repeats int, tokens_there long")
    given = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_given"), F.max("epoch").alias("most_uses"))
    out = spec.join(given, "source", "left").fillna(0, ["tokens_given", "most_uses"])
    whole = F.sum("tokens_given").over(Window.partitionBy(F.lit(0)))  # a row a target
    return out.select("source", "target_share", F.when(whole > 0, F.col("tokens_given") / whole).otherwise(0.0).alias("actual_share"), "tokens_given", "tokens_there", "max_repeats", "most_uses")
