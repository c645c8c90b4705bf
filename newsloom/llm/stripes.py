"""How often items occur together, and how much more than chance, by stripes.

An item's stripe is an associative array: its neighbours in all baskets, with how
often each was one. Every map task keeps the stripes of its baskets and adds to
them (in-mapper combining) up to a bound of memory, then sends them, cut into
segments by neighbour where an item has very many; stripes of one item and
segment meet and are merged key by key. A neighbour is kept with the rarer of two
items only: codes rise with frequency, and a stripe holds later codes, so the
stripes of frequent items are short. Two exact bounds keep hopeless items out
beforehand: a pair can't occur more often than its rarer item, so items in fewer
than `min_together` baskets drop out, and as n_ab <= min(n_a, n_b), a lift of L
needs max(n_a, n_b) <= N / L.

The work grows with the square of a basket's useful items, as any pair count's does.

Significance is Dunning's log-likelihood ratio over the 2x2 table of each pair; pairs
below `min_llr` are left out.

Defined results: an item counts once a basket; null items are ignored; null and
empty baskets are none; baskets of one item count for N; repeated baskets count
each, so the caller removes repeats; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.skew import HOT_SHARE, salted_lookup
from newsloom.session import shuffle_parts, written

#: An item's stripe is cut into segments of at most about so many neighbours; a segment is what one task merges at least.
MAX_STRIPE = 1_000_000
#: Pairs a task gathers before it adds them to its stripes, and entries its stripes may have before they are sent.
GATHER = 1_000_000
#: The 1 % level of the chi-square distribution with one degree of freedom.
MIN_LLR = 6.63


def item_counts(baskets: DataFrame) -> tuple[DataFrame, int]:
    """(`item`, `n`), and the number of baskets with an item, of `baskets` (`basket`: a non-empty array of distinct non-null items)."""
    counts = baskets.select(F.explode("basket").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts, baskets.count()


def dense_codes(items: DataFrame) -> DataFrame:
    """`items` with a dense `code` in the order of `n` (then `item`): a frequent item has a great code."""
    ranged = written(items.orderBy("n", "item").withColumn("_rid", F.monotonically_increasing_id()))
    part = F.shiftright("_rid", 33).cast("int")
    sizes = dict((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    start = F.get(F.array(*(F.lit(x).cast("long") for x in starts or [0])), part)
    return ranged.withColumn("code", start + F.col("_rid").bitwiseAND(2**33 - 1)).drop("_rid")


class Stripes:
    """Associative arrays of several items: for each (item, segment), neighbours with counts; kept as three parallel sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, seg: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((a, seg, b, n))
        self.waiting += len(a)

    def merge(self) -> tuple[np.ndarray, ...]:
        """All entries so far, each (item, segment, neighbour) once, in that order."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        a, seg, b, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((b, seg, a))
        a, seg, b, n = a[order], seg[order], b[order], n[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (seg[1:] != seg[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        merged = (a[at], seg[at], b[at], np.add.reduceat(n, at) if len(at) else n)
        self.parts, self.waiting = [merged], 0
        return merged

    def take(self, upto: int | None = None) -> pa.RecordBatch:
        """The stripes as rows (a, seg, bs, ns), taken out; with `upto`, only those before that entry."""
        entries = self.merge()
        upto = len(entries[0]) if upto is None else upto
        self.parts = [tuple(x[upto:] for x in entries)] if upto < len(entries[0]) else []
        a, seg, b, n = (x[:upto] for x in entries)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        ends = pa.array(np.append(at, len(a)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (b, n)]
        return pa.RecordBatch.from_arrays([pa.array(a[at], pa.int64()), pa.array(seg[at], pa.int64()), *lists], names=["a", "seg", "bs", "ns"])


def _later_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two members of every pair of each basket, the baskets' items lying one after another."""
    ends = np.cumsum(sizes)
    of = np.repeat(ends, sizes)
    place = np.arange(len(of))
    later = of - place - 1
    first = np.repeat(place, later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    return first, second


def _make_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the baskets of one task, from `codes` and `segs` (parallel arrays, codes rising)."""
    held = Stripes()
    for batch in batches:
        for start, stop in _slices(batch.column("codes")):
            codes, segs = (batch.column(c).slice(start, stop - start) for c in ("codes", "segs"))
            first, second = _later_pairs(codes.value_lengths().to_numpy(zero_copy_only=False))
            code, seg = codes.flatten().to_numpy(zero_copy_only=False), segs.flatten().to_numpy(zero_copy_only=False)
            a, b, k = code[first], code[second], seg[first]
            held.add(a, b % k, b, np.ones(len(a), np.int64))
            if held.waiting >= GATHER and len(held.merge()[0]) >= GATHER:
                yield held.take()
    yield held.take()


def _slices(baskets: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of baskets with about GATHER pairs together (one basket at least)."""
    sizes = baskets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes * (sizes - 1) // 2) // GATHER
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    return ((i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges stripes that come sorted by (a, seg): whatever lies before the last (a, seg) seen is complete."""
    held = Stripes()
    for batch in batches:
        lens = batch.column("bs").value_lengths().to_numpy(zero_copy_only=False)
        a, seg = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lens) for c in ("a", "seg"))
        held.add(a, seg, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bs", "ns")))
        if held.waiting >= GATHER:
            a, seg, _, _ = held.merge()
            done = int(np.searchsorted(a, a[-1], "left"))
            done += int(np.searchsorted(seg[done:], seg[-1], "left"))
            if done:
                yield held.take(done)
    yield held.take()


def stripes(baskets: DataFrame, items: DataFrame, total: int) -> DataFrame:
    """The merged stripes: `a`, `seg`, `bs`, `ns` (codes of the later neighbours and how often they occur with `a`)."""
    parts = shuffle_parts(baskets.sparkSession)
    coded = baskets.where(F.size("basket") > 1).select("bid", F.explode("basket").alias("item"))
    elements = items.agg(F.sum("n")).first()[0] or 0
    mean = max(1.0, elements / max(1, total))  # useful items a basket
    known = items.select("item", "code", F.ceil(F.col("n") * mean / MAX_STRIPE).cast("long").alias("segs"))
    hot = [(r["item"], r["n"] / elements) for r in items.where(F.col("n") > HOT_SHARE * elements).select("item", "n").collect()]  # at most 1 / HOT_SHARE
    sets = salted_lookup(coded, known, "item", hot=hot).groupBy("bid").agg(F.array_sort(F.collect_list(F.struct("code", "segs"))).alias("s")).where(F.size("s") > 1)
    made = sets.select("s.code", "s.segs").toDF("codes", "segs").mapInArrow(_make_stripes, "a long, seg long, bs array<long>, ns array<long>")
    return made.repartition(parts, "a", "seg").sortWithinPartitions("a", "seg").mapInArrow(_merge_stripes, "a long, seg long, bs array<long>, ns array<long>")


def stripe_counts(baskets: DataFrame, items: DataFrame, total: int, min_together: int = 1) -> DataFrame:
    """The merged stripes in long form, from `min_together` on: codes `a` < `b` and `n_ab`."""
    often = F.filter(F.arrays_zip("bs", "ns"), lambda x: x["ns"] >= min_together)
    return stripes(baskets, items, total).select("a", F.explode(often).alias("x")).select("a", F.col("x.bs").alias("b"), F.col("x.ns").alias("n_ab"))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, total: int) -> Column:
    """Dunning's G2 of the 2x2 table of a pair."""

    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    k11, k12, k21 = n_ab.cast("double"), (n_a - n_ab).cast("double"), (n_b - n_ab).cast("double")
    k22, n = F.lit(float(total)) - n_a - n_b + n_ab, F.lit(float(total))
    rows = xlogx(k11 + k12) + xlogx(k21 + k22)
    cols = xlogx(k11 + k21) + xlogx(k12 + k22)
    cells = xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22)
    return F.greatest(F.lit(0.0), 2.0 * (cells - rows - cols + xlogx(n)))


def together(baskets: DataFrame, min_together: int = 5, min_lift: int = 10, min_llr: float = MIN_LLR) -> DataFrame:
    """`article_a` < `article_b`, `n_ab`, `n_a`, `n_b`, `n_baskets`, `lift`, `llr` of the pairs with n_ab >= min_together, n_ab * N >= min_lift * n_a * n_b and llr >= min_llr.

    `baskets` has an array column `basket`.
    """
    baskets = written(baskets.select(F.array_distinct(F.array_compact("basket")).alias("basket")).where(F.size("basket") > 0).withColumn("bid", F.monotonically_increasing_id()))
    counts, total = item_counts(baskets)
    items = dense_codes(counts.where((F.col("n") >= min_together) & (F.col("n") * min_lift <= total)))
    pairs = stripe_counts(baskets, items, total, min_together)
    x, y = (items.select(F.col("code").alias(k), F.struct(F.col("item").alias("article"), "n").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    found = pairs.join(x, "a").join(y, "b").select("n_ab", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("g"))
    found = found.select(F.col("l.article").alias("article_a"), F.col("g.article").alias("article_b"), "n_ab", F.col("l.n").alias("n_a"), F.col("g.n").alias("n_b"))
    found = found.where(F.col("n_ab") * total >= min_lift * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))
    llr = log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), total)
    return found.select("article_a", "article_b", "n_ab", "n_a", "n_b", F.lit(total).cast("long").alias("n_baskets"), lift.alias("lift"), llr.alias("llr")).where(F.col("llr") >= min_llr)
