"""Several values packed in one field, split by EM-learned segmentation.

A field is a row of quoted spans (atomic, whatever they hold), unquoted stretches
of value characters, and separators. What is open is whether a joiner (`-`) in a
stretch separates two values or belongs to one. Each stretch with joiners is a
lattice: an edge is a candidate value, a run of neighbouring atoms; leaving a
joiner out of every edge costs a separator. Expectation-maximisation over all
distinct stretches of the whole column, weighted by how often they occur, learns
the frequency of each value and how likely a joiner separates, until that stands
still; Viterbi then picks each stretch's likeliest split, and these splits are the
rows. Stretches without a joiner have one path and only add to the frequencies.

Defined results: null, empty or all-separator fields give no rows; an empty
quoted span is no item and takes no position; an unpaired quote separates; a
field of any length is read whole; repeated rows keep their own items by
`row_id`; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from newsloom.operators.skew import hot_keys, salted_lookup
from newsloom.session import written

MAX_ROUNDS = 60
#: Learning ends when the share of separating joiners changes by less than this.
TOLERANCE = 1e-4
#: A candidate value has at most so many atoms, or is its whole stretch, so a lattice grows in proportion to its stretch.
MAX_EDGE = 16
_TOKEN = r"""("[^"]*"|'[^']*'|[A-Za-z0-9-]+)"""
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def tokens(df: DataFrame, fields: list[str], row_id: str) -> DataFrame:
    """`row_id`, `field_name`, `place` (of the token), `token` (trimmed, without quotes), `quoted`."""
    stacked = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("t")) for f in fields))).alias("x"))
    found = F.regexp_extract_all("x.t", F.lit(_TOKEN), F.lit(1))
    is_quoted = lambda t: t.startswith('"') | t.startswith("'")
    inside = lambda t: F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), f"^{_SPACE}|{_SPACE}$", "")
    piece = F.transform(found, lambda t: F.struct(F.when(is_quoted(t), inside(t)).otherwise(t).alias("token"), is_quoted(t).alias("quoted")))
    return stacked.select("row_id", "x.field_name", F.posexplode(F.filter(piece, lambda p: p["token"] != "")).alias("place", "p")).select("row_id", "field_name", "place", "p.*")


@cache
def edges_of(m: int) -> tuple[tuple[int, int], ...]:
    """Edges (first atom, one past the last) of a stretch of `m` atoms, by end and start: up to MAX_EDGE atoms each, and the whole stretch."""
    near = [(i, j) for j in range(1, m + 1) for i in range(max(0, j - MAX_EDGE), j)]
    return tuple(near if m <= MAX_EDGE else sorted([*near, (0, m)], key=lambda e: (e[1], e[0])))


def lattice(stretch: str) -> list[tuple[int, int, str]]:
    """Edges with their values, over the atoms between single joiners; an empty atom alone is no value."""
    atoms = stretch.split("-")
    return [(i, j, "-".join(atoms[i:j])) for i, j in edges_of(len(atoms)) if j - i > 1 or atoms[i]]


def _weights(ij: Sequence[tuple[int, int]], logp: np.ndarray, p_sep: float) -> np.ndarray:
    """Log weights of the edges (columns) of many stretches of one form (rows): each joiner within a value joins, the one before it separates."""
    inner = np.array([j - i - 1 for i, j in ij]) * log(max(1 - p_sep, 1e-300))
    return logp + inner + np.array([log(max(p_sep, 1e-300)) if i else 0.0 for i, _ in ij])


def posteriors(ij: Sequence[tuple[int, int]], logp: np.ndarray, p_sep: float) -> np.ndarray:
    """Probability of each edge (column) given its stretch (row), by forward and backward sums in logarithms; `ij` is in the order of `edges_of`."""
    w, m = _weights(ij, logp, p_sep), max(j for _, j in ij)
    f = np.full((m + 1, len(w)), -np.inf)
    b = f.copy()
    f[0], b[m] = 0.0, 0.0
    for k, (i, j) in enumerate(ij):
        f[j] = np.logaddexp(f[j], f[i] + w[:, k])
    for k in sorted(range(len(ij)), key=lambda k: -ij[k][0]):
        i, j = ij[k]
        b[i] = np.logaddexp(b[i], w[:, k] + b[j])
    i, j = np.array(ij).T
    with np.errstate(invalid="ignore"):  # a stretch all of whose values have no probability
        return np.nan_to_num(np.exp(f[i].T + w + b[j].T - f[m][:, None]))


def best_paths(ij: Sequence[tuple[int, int]], logp: np.ndarray, p_sep: float) -> list[list[int]]:
    """The edges (numbers in `ij`) of each stretch's likeliest split."""
    w, m = _weights(ij, logp, p_sep), max(j for _, j in ij)
    best, last = np.full((m + 1, len(w)), -np.inf), np.full((m + 1, len(w)), -1)
    best[0] = 0.0
    for k, (i, j) in enumerate(ij):
        score = best[i] + w[:, k]
        better = score > best[j]
        best[j], last[j] = np.where(better, score, best[j]), np.where(better, k, last[j])
    out = []
    for row in range(len(w)):
        path, at = [], m
        while at and last[at, row] >= 0:
            path.append(int(last[at, row]))
            at = ij[path[-1]][0]
        out.append(path[::-1])
    return out


def forward_backward(edges: list[tuple[int, int, float]], p_sep: float) -> tuple[list[float], float]:
    """Posterior of each edge (i, j, probability) of one stretch, and the expected number of separating joiners."""
    order = sorted(range(len(edges)), key=lambda k: (edges[k][1], edges[k][0]))
    with np.errstate(divide="ignore"):
        found = posteriors([edges[k][:2] for k in order], np.log([[edges[k][2] for k in order]]), p_sep)[0]
    post = dict(zip(order, found.tolist(), strict=True))
    return [post[k] for k in range(len(edges))], sum(p for k, p in post.items() if edges[k][0])


def viterbi(edges: list[tuple[int, int, str, float]], p_sep: float) -> list[str]:
    """The values of one stretch's likeliest split."""
    order = sorted(edges, key=lambda e: (e[1], e[0]))
    with np.errstate(divide="ignore"):
        (path,) = best_paths([e[:2] for e in order], np.log([[e[3] for e in order]]), p_sep)
    return [order[k][2] for k in path]


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row an edge that has a value: `k` is its number in `edges_of(m)`."""
    for b in batches:
        rows = []
        for sid, s, c in zip(b["sid"], b["stretch"], b["c"], strict=True):
            atoms = s.split("-")
            m = len(atoms)
            rows += [(sid, c, m, k, "-".join(atoms[i:j])) for k, (i, j) in enumerate(edges_of(m)) if j - i > 1 or atoms[i]]
        yield pd.DataFrame(rows, columns=["sid", "c", "m", "k", "value"])


def _by_form(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Stretches of the same number of atoms together: their rows in the batch, the number, values (hashes) and log probabilities by edge; edges without a value have none."""
    lens = b.column("k").value_lengths().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lens)), lens)
    k, v, p = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "value", "p"))
    forms = b.column("m").to_numpy(zero_copy_only=False)
    place = np.zeros(len(lens), dtype=np.int64)
    for m in np.unique(forms):
        rows = np.flatnonzero(forms == m)
        place[rows] = np.arange(len(rows))
        here = forms[of] == m
        shape = (len(rows), len(edges_of(int(m))))
        value, logp = np.zeros(shape, dtype=np.int64), np.full(shape, -np.inf)
        value[place[of[here]], k[here]], logp[place[of[here]], k[here]] = v[here], np.log(np.maximum(p[here], 1e-300))
        yield rows, int(m), value, logp


def _expect(p_sep: float):
    """Expected uses of each value, and of separating joiners: one row a value and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, found = b.column("c").to_numpy(zero_copy_only=False), []
            for rows, m, value, logp in _by_form(b):
                ij, used = edges_of(m), np.isfinite(logp)
                post = posteriors(ij, logp, p_sep) * c[rows][:, None].astype(float)
                starts = np.broadcast_to(np.array([i > 0 for i, _ in ij]), post.shape)
                found.append((value[used], post[used], (starts * post)[used]))
            if found:
                value, n, seps = (np.concatenate(x) for x in zip(*found, strict=True))
                names, at = np.unique(value, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, n)), pa.array(np.bincount(at, seps))], names=["value", "n", "seps"])

    return run


def _best(p_sep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid = b.column("sid").to_numpy(zero_copy_only=False)
            for rows, m, _, logp in _by_form(b):
                ij = edges_of(m)
                ends = [[ij[k][1] for k in path] for path in best_paths(ij, logp, p_sep)]
                yield pa.RecordBatch.from_arrays([pa.array(sid[rows]), pa.array(ends, pa.list_(pa.int32()))], names=["sid", "ends"])

    return run


def learn_splits(found: DataFrame, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`stretch`, `split`: the Viterbi split of each distinct stretch that has joiners, by frequencies learned over the whole column until the share of separating joiners stands still."""
    counted = written(found.where("not quoted").groupBy(F.col("token").alias("stretch")).agg(F.count(F.lit(1)).alias("c")).withColumn("sid", F.monotonically_increasing_id()))
    open_ = counted.where(F.col("stretch").contains("-"))
    plain = counted.where(~F.col("stretch").contains("-")).select(F.xxhash64("stretch").alias("value"), F.col("c").cast("double").alias("n"))
    # Values are told apart by 64 bits of hash: all a collision could do is to add two frequencies.
    edges = written(open_.select("sid", "stretch", "c").mapInPandas(_edges, "sid long, c long, m int, k int, value string").withColumn("value", F.xxhash64("value")))
    joiners = open_.agg(F.sum(F.col("c") * (F.length("stretch") - F.length(F.regexp_replace("stretch", "-", "")))).cast("double")).first()[0] or 0.0
    used = edges.agg(F.sum("c").cast("double")).first()[0] or 0.0
    plain_total = plain.agg(F.sum("n")).first()[0] or 0.0
    hot = hot_keys(edges, F.col("value"))
    p_sep, step = 0.5, edges.groupBy("value").agg(F.sum("c").cast("double").alias("n"))

    def scored() -> DataFrame:
        p = step.select("value", "n").unionByName(plain).groupBy("value").agg((F.sum("n") / max(used + plain_total, 1.0)).alias("p"))
        return salted_lookup(edges, p, "value", hot=hot).groupBy("sid", "c", "m").agg(F.collect_list(F.struct("k", "value", "p")).alias("e")).select("sid", "c", "m", "e.k", "e.value", "e.p")  # at most MAX_EDGE * m + 1

    for _ in range(rounds if joiners else 0):
        seen = Observation()
        step = written(scored().mapInArrow(_expect(p_sep), "value long, n double, seps double").observe(seen, F.sum("n").alias("n"), F.sum("seps").alias("seps")))
        used, seps = seen.get["n"] or 0.0, seen.get["seps"] or 0.0
        before, p_sep = p_sep, min(max(seps / joiners, 1e-9), 1 - 1e-9)
        if abs(p_sep - before) < tolerance:
            break
    paths = scored().mapInArrow(_best(p_sep), "sid long, ends array<int>")
    atoms = F.split("stretch", "-", -1)
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    piece = F.zip_with(starts, "ends", lambda i, j: F.array_join(F.slice(atoms, i + 1, j - i), "-"))
    return paths.join(open_.select("sid", "stretch"), "sid").select("stretch", piece.alias("split"))


def unpack(df: DataFrame, fields: list[str], row_id: str, exact: bool = False, rounds: int = MAX_ROUNDS) -> DataFrame:
    """`row_id`, `field_name`, `item_position`, `item`: one row per packed value, as the Viterbi splits have it; with `exact` no joiner separates, whatever was learned."""
    found = tokens(df, fields, row_id)
    splits = written(learn_splits(found, rounds).where(F.size("split") > 1))
    if exact or not splits.take(1):
        return found.select("row_id", "field_name", F.col("place").alias("item_position"), F.col("token").alias("item"))
    by_token = salted_lookup(found, splits.withColumnRenamed("stretch", "token"), "token", "left")
    parts = by_token.withColumn("parts", F.when(F.col("quoted") | F.col("split").isNull(), F.array("token")).otherwise(F.col("split")))
    before = Window.partitionBy("row_id", "field_name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shifted = parts.withColumn("_b", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    return shifted.select("row_id", "field_name", "_b", F.posexplode("parts").alias("k", "item")).select("row_id", "field_name", (F.col("_b") + F.col("k")).cast("int").alias("item_position"), "item")
