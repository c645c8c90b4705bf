"""Blocks of queries that meet all items, block by block, in one task each, so that only each query's best are put out.

Every block of queries gets its own copy of the items: their bytes are shuffled
once a block of queries, but no (query, item) pair ever leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "query_id string, article_id string, rank int, score double"
#: Scores kept in one task's memory: queries of a block times k.
KEPT = 4_000_000


def n_blocks(n_queries: int, k: int, cores: int) -> int:
    """As many blocks as memory needs; up to the cores, blocks of 256 queries at least."""
    return max(-(-n_queries * k // KEPT), min(cores, n_queries // 256), 1)


def laid_out(queries: DataFrame, sides: list[DataFrame], n: int, *order: str) -> DataFrame:
    """Each block `qb` of `queries` (`vb` -1) and a copy of the sides in a partition of its own, in `order`."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = queries.withColumn("vb", F.lit(-1))
    for side in sides:
        rows = rows.unionByName(side.withColumn("qb", every), allowMissingColumns=True)
    return rows.repartitionById(n, F.col("qb")).sortWithinPartitions(*order)


def meet(queries: DataFrame, sides: list[DataFrame], n: int, run: Callable[[Iterator[tuple[int, pa.Table]]], Iterator[pa.RecordBatch]], schema: str = RESULT) -> DataFrame:
    """`run` over each block `qb` of `queries`: their table (`vb` -1) comes behind those of `sides` with `vb` below -1, those with `vb` from 0 after it, in order. Columns a side hasn't are null."""
    rows = laid_out(queries, sides, n, "qb", "vb")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(tables(batches), lambda x: x[0]):
            yield from run((vb, t) for _, vb, t in own)

    return rows.mapInArrow(each, schema)


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(qb, vb, table) of each run of equal (qb, vb)."""
    held, key = [], None
    for b in batches:
        q, v = (b.column(c).to_numpy() for c in ("qb", "vb"))
        cuts = [0, *(np.flatnonzero((np.diff(q) != 0) | (np.diff(v) != 0)) + 1).tolist(), len(q)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if key != (q[start], v[start]):
                if held:
                    yield int(key[0]), int(key[1]), pa.Table.from_batches(held)
                held, key = [], (q[start], v[start])
            held.append(b.slice(start, end - start))
    if held:
        yield int(key[0]), int(key[1]), pa.Table.from_batches(held)


def block_of(number: Column, size: int) -> Column:
    return F.floor(number / size).cast("int")


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` greatest (already rounded) scores, greatest first, equal ones in their order."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.argsort(-score[at], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")


def whole(col: pa.ChunkedArray) -> pa.Array:
    a = col.combine_chunks()
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def lists(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and flattened values of a list column."""
    a = whole(col)
    return np.diff(a.offsets.to_numpy()), a.flatten()


def put_out(ids: list[str], want: list[list[str] | None], found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of each query's best (article ids, scores); of a query with a `want`, only those in it."""
    q, a, r, s = [], [], [], []
    for qid, only, (items, score) in zip(ids, want, found, strict=True):
        wanted = None if only is None else set(only)
        keep = [j for j, x in enumerate(items) if wanted is None or x in wanted]
        q += [qid] * len(keep)
        a += [items[j] for j in keep]
        r += [j + 1 for j in keep]
        s += [float(score[j]) for j in keep]
        if len(q) >= 50_000:
            yield _batch(q, a, r, s)
            q, a, r, s = [], [], [], []
    yield _batch(q, a, r, s)


def _batch(q: list, a: list, r: list, s: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(a, pa.string()), pa.array(r, pa.int32()), pa.array(s, pa.float64())], names=["query_id", "article_id", "rank", "score"])
