"""Filling containers of fixed capacity with texts, by bounded-space online best-fit.

Texts arrive in hash order, spread over buckets of about BUCKET_BINS containers.
A bucket keeps at most OPEN_BINS open containers, in a bitset keyed by their free
space: the lowest set bit at or above a text's size is the best fit. Where none
fits and all are in use, the fullest is closed. What is still open at the end of a
bucket is packed again, MERGE buckets at a time, until one bucket is left, so
few containers stay part-filled whatever the number of tasks.

A text over the capacity is cut into full containers of its own and a rest, which
is packed as an item; no other text is split.

Defined results: a text of 0 tokens (null or empty) needs no container and comes
out with a null container; repeated rows and equal sizes are packed each; kinds
with a null or non-positive capacity are left out; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import shuffle_parts, written

OPEN_BINS = 256
BUCKET_BINS = 4096
MERGE = 16
MAX_KINDS = 1_000


class BestFit:
    """Open containers of one bucket. `add` returns containers closed by it, each a list of items."""

    def __init__(self, capacity: int, bins: int = OPEN_BINS) -> None:
        self.capacity, self.bins, self.used = capacity, bins, 0
        self.free: dict[int, list[list]] = {}
        self.bits = 0

    def _take(self, free: int) -> list:
        stack = self.free[free]
        found = stack.pop()
        if not stack:
            del self.free[free]
            self.bits &= ~(1 << free)
        return found

    def add(self, size: int, item) -> list[list]:
        closed = []
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            items = self._take(free)
        else:
            if self.used == self.bins:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.used -= 1
            free, items = self.capacity, []
            self.used += 1
        items.append(item)
        left = free - size
        if left:
            self.free.setdefault(left, []).append(items)
            self.bits |= 1 << left
        else:
            closed.append(items)
            self.used -= 1
        return closed

    def rest(self) -> list[list]:
        return [items for free in sorted(self.free) for items in self.free[free]]


_SCHEMA = "container_kind string, capacity int, bucket long, last boolean, container_id string, k long, doc_id {0}, piece int, token_start long, n_tokens long"


def _pack(round_no: int, bins: int):
    cols = ["container_kind", "capacity", "bucket", "last", "container_id", "k", "doc_id", "piece", "token_start", "n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fit, seq, out = None, None, 0, []

        def put(containers: list[list], done: bool) -> None:
            nonlocal seq
            kind, capacity, bucket, last = at
            for items in containers:
                name = f"{kind}-{round_no}-{bucket}-{seq}" if done else None
                seq += 1
                out.extend((kind, capacity, bucket, last, name, *x) for x in items)

        for b in batches:
            for row in zip(*(b[c].tolist() for c in cols if c != "container_id"), strict=True):
                group, (k, doc, piece, start, size) = row[:4], row[4:]
                if group != at:
                    if at:
                        put(fit.rest(), bool(at[3]))
                    at, fit, seq = group, BestFit(group[1], bins), 0
                item = (k, doc, piece, start)
                while size > group[1]:
                    put([[(k, doc, piece, start, group[1])]], True)
                    piece, start, size = piece + 1, start + group[1], size - group[1]
                    item = (k, doc, piece, start)
                put(fit.add(size, (*item, size)), True)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if at:
            put(fit.rest(), bool(at[3]))
        yield pd.DataFrame(out, columns=cols)

    return run


def pack(sizes: DataFrame, kinds: DataFrame, open_bins: int = OPEN_BINS, bucket_bins: int = BUCKET_BINS) -> DataFrame:
    """`container_kind`, `container_id`, `doc_id`, `piece`, `token_start`, `n_tokens` of every text (`sizes`: doc_id, n_tokens) for every kind."""
    spark = sizes.sparkSession
    listed = kinds.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().limit(MAX_KINDS + 1).collect()
    if len(listed) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = {(r[0], r[1]): max(1, total // (r[1] * bucket_bins)) for r in listed}
    doc_type = dict(sizes.dtypes)["doc_id"]
    schema = _SCHEMA.format(doc_type)
    spec = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("int").alias("capacity"), F.lit(n).cast("long").alias("n")) for (k, c), n in sorted(buckets.items())))
    if not buckets:
        return sizes.where("false").select(F.lit("").alias("container_kind"), F.lit("").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), "n_tokens")
    items = sizes.select("doc_id", "n_tokens", F.xxhash64("doc_id").alias("k"), F.explode(spec).alias("x"))
    items = items.select(F.col("x.kind").alias("container_kind"), F.col("x.capacity").alias("capacity"), F.pmod("k", "x.n").alias("bucket"), (F.col("x.n") == 1).alias("last"), "k", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), "n_tokens")
    empty = items.where("n_tokens = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), "doc_id", "piece", "token_start", "n_tokens")
    final = ["container_kind", "container_id", "doc_id", "piece", "token_start", "n_tokens"]
    done, todo, most, r = [empty], items.where("n_tokens > 0"), max(buckets.values()), 0
    while True:
        placed = todo.repartition(shuffle_parts(spark), "container_kind", "bucket").sortWithinPartitions("container_kind", "bucket", "k", "doc_id", "piece", "n_tokens").mapInPandas(_pack(r, open_bins), schema)
        if most == 1:
            return _united([*done, placed.select(*final)])
        placed = written(placed)
        done.append(placed.where("container_id is not null").select(*final))
        most, r = -(-most // MERGE), r + 1
        per_kind = {k: n for k, n in buckets.items()}
        buckets = {k: -(-n // MERGE) for k, n in per_kind.items()}
        last = F.array_contains(F.array(*(F.lit(k) for (k, _), n in buckets.items() if n == 1), F.lit("").cast("string")), F.col("container_kind"))
        todo = placed.where("container_id is null").select("container_kind", "capacity", F.floor(F.col("bucket") / MERGE).cast("long").alias("bucket"), last.alias("last"), "k", "doc_id", "piece", "token_start", "n_tokens")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
