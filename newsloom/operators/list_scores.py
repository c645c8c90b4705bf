"""BM25 and vector scores of whole candidate lists: histories and lists travel as ids, words and vectors only with the articles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import tokenize
from newsloom.operators import blocks, bm25
from newsloom.session import written

SCORES = "impression_id string, bm25 array<double>, emb array<double>"
#: Impressions of a block, and articles that are read at once.
LISTS, ARTICLES = 200_000, 20_000
#: Cells of the table of an impression's words.
_CELLS = 40_000_000


def score_lists(shown: DataFrame, history: DataFrame, articles: DataFrame, index: bm25.Index, vectors: DataFrame) -> DataFrame:
    """`impression_id` and two arrays beside `cands` of `shown`: `bm25`, scores for the words of the titles in the history (null without a title there), and `emb`, cosines with the mean vector of the history (null without a vector there).

    The same scores as `bm25.score_candidates` and `retrieval.score_candidates` give.
    """
    none = F.array().cast("array<string>")
    h = history.select("impression_id", F.col("hist.article_id").alias("h"))
    q = written(shown.select("impression_id", F.coalesce("cands", none).alias("c")).join(h, "impression_id"))
    n = blocks.n_blocks(q.count(), blocks.KEPT // LISTS, q.sparkSession.sparkContext.defaultParallelism)
    q = q.withColumn("qb", F.pmod(F.xxhash64("impression_id"), F.lit(n)).cast("int"))
    vocabulary = index.terms.select(F.lit(-2).alias("vb"), "term", "idf")
    equal = by_vector(vectors)
    words = articles.select("article_id", F.size(tokenize(F.col("title"))).alias("n_title"), F.col("title").isNotNull().alias("titled")).join(index.words, "article_id")
    words = words.select((1 + F.pmod(F.xxhash64("article_id"), F.lit(-(-index.n_docs // ARTICLES) or 1))).cast("int").alias("vb"), "article_id", F.when(F.col("titled"), F.col("n_title")).otherwise(-1).alias("n_title"), "w")
    avgdl = index.avgdl

    def run(tables: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        block, terms, idf = None, pa.array([], pa.string()), np.empty(0)
        for vb, t in tables:
            if vb == -2:
                terms, idf = blocks.whole(t["term"]), t["idf"].to_numpy()
            elif vb == -1:
                block = _Lists(t, terms, idf, avgdl)
            elif block is not None and vb == 0:
                block.add_vectors(t)
            elif block is not None:
                block.add_words(t)
        if block is not None:
            yield from block.scores()

    return blocks.meet(q, [vocabulary, equal, words], n, run, SCORES)


def by_vector(vectors: DataFrame) -> DataFrame:
    """A side of `blocks.meet`: each distinct `vec` and the `ids` of its articles."""
    return vectors.groupBy("vec", F.pmod(F.xxhash64("article_id"), F.lit(16))).agg(F.collect_list("article_id").alias("ids")).select(F.lit(0).alias("vb"), "vec", "ids")


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Words:
    """Distinct words of the articles that a block names, in one list; `w` beside them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def close(self, n: int) -> None:
        ref, self.term, self.w = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.empty(0, int) for k in range(3))
        order = np.argsort(ref, kind="stable")
        self.term, self.w = self.term[order], self.w[order]
        self.size = np.bincount(ref, minlength=n)
        self.start = np.cumsum(self.size) - self.size
        self.parts = []


class _Lists:
    def __init__(self, t: pa.Table, terms: pa.Array, idf: np.ndarray, avgdl: float) -> None:
        self.ids, self.terms, self.idf, self.avgdl = blocks.whole(t["impression_id"]), terms, idf, avgdl
        (self.n_hist, hist), (self.n_cand, cand) = blocks.lists(t["h"]), blocks.lists(t["c"])
        self.refs = pc.unique(pa.chunked_array([hist, cand], pa.string()))
        self.hist, self.cand = (pc.index_in(x, value_set=self.refs).to_numpy() for x in (hist, cand))
        self.vec_of, self.vecs = np.full(len(self.refs), -1), np.empty((0, 1))
        self.titled, self.title, self.text = np.zeros(len(self.refs), bool), _Words(), _Words()

    def add_vectors(self, t: pa.Table) -> None:
        sizes, names = blocks.lists(t["ids"])
        ref = pc.fill_null(pc.index_in(names, value_set=self.refs), -1).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)[ref >= 0]
        used, at = np.unique(row, return_inverse=True)
        self.vec_of[ref[ref >= 0]] = at
        self.vecs = blocks.lists(t["vec"])[1].to_numpy().reshape(len(t), -1)[used]

    def add_words(self, t: pa.Table) -> None:
        ref = pc.fill_null(pc.index_in(blocks.whole(t["article_id"]), value_set=self.refs), -1).to_numpy()
        t, ref = t.filter(pa.array(ref >= 0)), ref[ref >= 0]
        if not len(ref):
            return
        n_title, (dl, words) = t["n_title"].to_numpy(), blocks.lists(t["w"])
        self.titled[ref] = n_title >= 0
        code = pc.index_in(words, value_set=self.terms).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(dl)), dl)
        in_title = np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl) < n_title[doc]
        cells, tf = np.unique(doc * len(self.terms) + code, return_counts=True)
        at, term = np.divmod(cells, max(1, len(self.terms)))
        w = self.idf[term] * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl[at] / self.avgdl))
        self.text.parts.append((ref[at], term.astype(np.int32), w))
        at, term = np.divmod(np.unique((doc * len(self.terms) + code)[in_title]), max(1, len(self.terms)))
        self.title.parts.append((ref[at], term.astype(np.int32), np.empty(len(at), np.int8)))

    def scores(self) -> Iterator[pa.RecordBatch]:
        self.title.close(len(self.refs))
        self.text.close(len(self.refs))
        step = max(16, min(2000, _CELLS // max(1, len(self.terms))))
        h_end, c_end = np.cumsum(self.n_hist), np.cumsum(self.n_cand)
        for a in range(0, len(self.ids), step):
            b = min(a + step, len(self.ids))
            hist = self.hist[h_end[a] - self.n_hist[a] : h_end[b - 1]]
            cand = self.cand[c_end[a] - self.n_cand[a] : c_end[b - 1]]
            of_hist, of_cand = (np.repeat(np.arange(b - a), n[a:b]) for n in (self.n_hist, self.n_cand))
            offsets = pa.array(np.append(0, np.cumsum(self.n_cand[a:b])), pa.int32())
            two = (self._lexical(b - a, hist, of_hist, cand, of_cand), self._cosines(b - a, hist, of_hist, cand, of_cand))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.round(s, 9), pa.float64()), mask=pa.array(~known)) for known, s in two]
            yield pa.RecordBatch.from_arrays([self.ids[a:b].cast(pa.string()), *arrays], names=["impression_id", "bm25", "emb"])

    def _lexical(self, n: int, hist: np.ndarray, of_hist: np.ndarray, cand: np.ndarray, of_cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.bincount(of_hist, self.titled[hist], n) > 0
        asked = np.zeros((n, max(1, len(self.terms))), bool)
        asked[np.repeat(of_hist, self.title.size[hist]), self.title.term[spans(self.title.start[hist], self.title.size[hist])]] = True
        at = spans(self.text.start[cand], self.text.size[cand])
        row = np.repeat(np.arange(len(cand)), self.text.size[cand])
        hit = asked[of_cand[row], self.text.term[at]]
        return known, np.bincount(row[hit], self.text.w[at[hit]], len(cand))

    def _cosines(self, n: int, hist: np.ndarray, of_hist: np.ndarray, cand: np.ndarray, of_cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        has = self.vec_of[hist] >= 0
        of, count = of_hist[has], np.bincount(of_hist[has], minlength=n)
        known, user = count > 0, np.zeros((n, self.vecs.shape[1]))
        if known.any():
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            user[known] = np.add.reduceat(self.vecs[self.vec_of[hist[has]]], first, axis=0) / count[known, None]
        length = np.sqrt((user**2).sum(axis=1, keepdims=True))
        user /= np.where(length == 0, 1.0, length)
        score, seen = np.zeros(len(cand)), self.vec_of[cand] >= 0
        score[seen] = (user[of_cand[seen]] * self.vecs[self.vec_of[cand[seen]]]).sum(axis=1)
        return known, score
