"""BM25 over the article catalogue: index tables, full search and candidate scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import article_text, tokenize
from newsloom.operators import blocks
from newsloom.operators.sampling import dense_numbers
from newsloom.session import written

K1, B = 1.5, 0.75


@dataclass
class Index:
    docs: DataFrame  # article_id, dl
    words: DataFrame  # article_id, w: its words, as often as they occur
    postings: DataFrame  # term, article_id, tf
    terms: DataFrame  # term, df, idf
    n_docs: int
    avgdl: float


def build(articles: DataFrame, idf_floor: float | None = None, words: Column | None = None) -> Index:
    """All articles count for N and the mean length, also those without a word. `idf_floor` gives the floored variant, `words` other words (such as stems)."""
    words = articles.select("article_id", (tokenize(article_text(F.col("title"), F.col("abstract"))) if words is None else words).alias("w"))
    docs = words.select("article_id", F.size("w").alias("dl"))
    n, avgdl = docs.agg(F.count(F.lit(1)), F.avg("dl")).first()
    postings = words.select("article_id", F.explode("w").alias("term")).groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if idf_floor is not None:
        idf = F.greatest(idf, F.lit(idf_floor))
    terms = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf)
    return Index(docs, words, postings, terms, n, avgdl or 1.0)


def impact(i: Index, idf: Column, tf: Column, dl: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / i.avgdl))


def impacts(i: Index, k1: float = K1, b: float = B) -> DataFrame:
    """`term`, `article_id`, `w`: what the term adds to the article's score."""
    return i.postings.join(i.docs, "article_id").join(i.terms, "term").select("term", "article_id", impact(i, F.col("idf"), F.col("tf"), F.col("dl"), k1, b).alias("w"))


class _Block:
    """The postings of a block of articles, numbered in the order of their ids, for the terms that a block of queries asks for."""

    def __init__(self, t: pa.Table, vocabulary: pa.Array, idf: np.ndarray, avgdl: float) -> None:
        sizes, words = blocks.lists(t["w"])
        code = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
        cells, tf = np.unique(code[code >= 0].astype(np.int64) * len(sizes) + doc, return_counts=True)
        term, self.doc = np.divmod(cells, max(1, len(sizes)))
        self.n, self.start = len(sizes), np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / avgdl))
        self.most = np.array([self.w[a:b].max() if b > a else 0.0 for a, b in zip(self.start, self.start[1:], strict=False)])

    def search(self, terms: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(articles, rounded scores), best first: all of the `k` best that score at least `least`."""
        n = self.start[terms + 1] - self.start[terms]
        terms = terms[n > 0][np.argsort(n[n > 0], kind="stable")]
        n = np.sort(n[n > 0])
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0.0)
        # The rarest terms alone may show that no article without them is among the best: then the frequent ones are only looked up.
        m = int(np.searchsorted(np.cumsum(n), self.n // 16))
        for m in ([m] if 0 < m < len(terms) else []) + [len(terms)]:
            some, score = self._sums(terms[:m])
            if m == len(terms):
                break
            bar = max(least, np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else 0.0)
            if bar > rest[m] + 1e-6:
                near = score + rest[m] >= bar - 1e-6
                some, score = some[near], score[near]
                for t in terms[m:]:
                    doc, w = (x[self.start[t] : self.start[t + 1]] for x in (self.doc, self.w))
                    at = np.minimum(np.searchsorted(doc, some), len(doc) - 1)
                    score += np.where(doc[at] == some, w[at], 0.0)
                break
        score = np.round(score, 9)
        top = blocks.best(score, k)
        return some[top], score[top]

    def _sums(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = [slice(self.start[t], self.start[t + 1]) for t in terms]
        if not cuts:
            return np.empty(0, int), np.empty(0)
        doc, w = np.concatenate([self.doc[c] for c in cuts]), np.concatenate([self.w[c] for c in cuts])
        if len(doc) < self.n // 8:
            some, at = np.unique(doc, return_inverse=True)
            return some, np.bincount(at, w)
        score = np.bincount(doc, w, self.n)
        some = np.flatnonzero(score > 0)
        return some, score[some]


def search(i: Index, queries: DataFrame, k: int = 50, block: int = 1 << 17) -> DataFrame:
    """`query_id`, `article_id`, `rank`, `score` of the `k` best articles of each query (`query_id`, `terms`: array, or `term`: a row a term), those without a common term never; ties by article_id.

    With a column `want` (array of ids), only those of the best that are in it are put out. Queries of the same words are one search.
    """
    if "terms" not in queries.columns:
        queries = queries.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    want = F.col("want") if "want" in queries.columns else F.lit(None).cast("array<string>")
    q = written(queries.select("query_id", F.array_sort(F.array_distinct("terms")).alias("terms"), want.alias("want")))
    docs = dense_numbers(i.words, "article_id")
    n = blocks.n_blocks(q.count(), k, q.sparkSession.sparkContext.defaultParallelism)
    q = q.withColumn("qb", F.pmod(F.xxhash64("terms"), F.lit(n)).cast("int"))
    vocabulary = i.terms.select(F.lit(-2).alias("vb"), "term", "idf")
    items = docs.select(blocks.block_of(F.col("row_no"), block).alias("vb"), "row_no", "article_id", "w")
    avgdl = i.avgdl

    def run(tables: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        asked: list[np.ndarray] = []
        for vb, t in tables:
            if vb == -2:
                words, idf = t["term"].combine_chunks(), t["idf"].to_numpy()
            elif vb == -1:
                sizes, flat = blocks.lists(t["terms"])
                code = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy()
                ids, want = t["query_id"].to_pylist(), t["want"].to_pylist()
                seen: dict[bytes, int] = {}
                which = [seen.setdefault(c[c >= 0].tobytes(), len(seen)) for c in np.split(code, np.cumsum(sizes)[:-1])]
                asked = [np.frombuffer(x, code.dtype) for x in seen]
                best = [(np.empty(0, np.int64), np.empty(0)) for _ in asked]
            elif asked:
                order = np.argsort(t["row_no"].to_numpy())
                t = t.take(order)
                names.append(np.array(t["article_id"].to_pylist(), dtype=object))
                b = _Block(t, words, idf, avgdl)
                for x, terms in enumerate(asked):
                    number, score = best[x]
                    some, more = b.search(terms, k, score[-1] if len(score) == k else 0.0)
                    both = np.concatenate([score, more])
                    top = blocks.best(both, k)
                    best[x] = np.concatenate([number, some + vb * block])[top], both[top]
        if asked and names:
            every = np.concatenate(names)
            yield from blocks.put_out(ids, want, ((every[best[x][0]], best[x][1]) for x in which))

    return blocks.meet(q, [vocabulary, items], n, run)


def score_candidates(i: Index, cands: DataFrame, queries: DataFrame) -> DataFrame:
    """`cands` with `score`: of each candidate for its impression's query (`impression_id`, `terms`: array of distinct terms).

    Only the shown candidates are scored. Each article carries its terms' impacts as
    a map; the common terms come from a hashed array intersection. Unknown articles,
    and those without a common term, score 0 and stay.
    """
    maps = impacts(i).groupBy("article_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("m"))
    both = cands.join(queries.select("impression_id", "terms"), "impression_id").join(maps, "article_id", "left")
    total = F.aggregate(F.array_sort(F.array_intersect(F.map_keys("m"), "terms")), F.lit(0.0), lambda s, t: s + F.element_at("m", t))
    return both.withColumn("score", F.round(F.coalesce(total, F.lit(0.0)), 9)).drop("m", "terms")


def history_queries(history: DataFrame, articles: DataFrame) -> DataFrame:
    """`impression_id`, `terms`: the distinct words of the non-null titles in each history; impressions without any are left out."""
    h = history.select("impression_id", F.explode("hist.article_id").alias("article_id"))
    titled = h.join(articles.where("title is not null").select("article_id", "title"), "article_id")
    return titled.groupBy("impression_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tokenize(F.col("title")))))).alias("terms"))
