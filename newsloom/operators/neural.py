"""Neural news recommendation: news encoder, self-attention over the history, additive attention, dot product.

Two forms. The base form encodes an article by one ReLU layer; the improved one by
two GELU layers with a residual and layer normalisation, and is wider. In both the
history may get sinusoidal positions, and self-attention is followed by a residual
and layer normalisation.

Weights are small and either trained here or given. Training is by mini-batches over
all impressions: each task of a barrier stage holds its share of them as numbers of
vectors, and the tasks add up their gradients, so that all take the same steps and no
row comes to the driver. What a step is made of depends on the impressions' ids alone,
not on how many tasks there are. In inference, blocks of impressions meet the vectors,
and only ids and scores are shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import tape
from newsloom.functions.tape import Var
from newsloom.operators import blocks
from newsloom.operators.list_scores import LISTS, by_vector, spans
from newsloom.operators.together import Together, fit_together
from newsloom.session import written

#: Impressions that a task of the fit should have at least, and those that are encoded at once.
PER_TASK, CHUNK = 2_000, 500
#: Sizes and heads of the two forms.
FORMS = {"base": {"size": 32, "heads": 4}, "improved": {"size": 256, "heads": 8}}


@dataclass
class Weights:
    """Named arrays, and the form they belong to."""

    params: dict[str, np.ndarray] = field(default_factory=dict)
    heads: int = 4
    improved: bool = False
    positions: bool = False

    def arrays(self) -> list[np.ndarray]:
        return list(self.params.values())


def initial(dims: int, size: int = 32, heads: int = 4, seed: int = 42, improved: bool = False, positions: bool = False) -> Weights:
    rng = np.random.default_rng(seed)
    m = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    p = {"news": m(dims, size), "bias": np.zeros(size), **{k: m(size, size) for k in ("q", "k", "v", "pool")}, "pool_q": rng.normal(0, 1 / np.sqrt(size), (size, 1)), "user_scale": np.ones(size), "user_shift": np.zeros(size)}
    if improved:
        p |= {"news2": m(size, size), "bias2": np.zeros(size), "news_scale": np.ones(size), "news_shift": np.zeros(size)}
    return Weights(p, heads, improved, positions)


def places(n: int, size: int) -> np.ndarray:
    """Sinusoidal positions 0 to n - 1."""
    angle = np.arange(n)[:, None] / 10_000 ** (2 * (np.arange(size) // 2) / size)
    return np.where(np.arange(size) % 2 == 0, np.sin(angle), np.cos(angle))


def _news(w: Weights, p: dict[str, Var], x: np.ndarray) -> Var:
    h = tape.add(tape.project(x, p["news"]), p["bias"])
    if not w.improved:
        return tape.relu(h)
    h = tape.gelu(h)
    deep = tape.gelu(tape.add(tape.matmul(h, p["news2"]), p["bias2"]))
    return tape.add(tape.mul(tape.normalise(tape.add(h, deep)), p["news_scale"]), p["news_shift"])


def _user(w: Weights, p: dict[str, Var], h: Var, at: np.ndarray, there: np.ndarray) -> Var:
    """User vectors (users x size) of histories `at` (users x n) rows of the encoded `h`, of those that are `there` (users x n), one at least of each user.

    An item's query, key and value are linear in it and in its place, so they are made once of each row of `h`, and no absent item is multiplied.
    """
    size = h.value.shape[1]
    qkv = tape.beside(*(p[x] for x in "qkv"))
    item = tape.take(tape.beside(h, tape.matmul(h, qkv)), at[there])
    if w.positions:
        pe = places(there.shape[1], size).astype(h.value.dtype)
        item = tape.add(item, tape.take(tape.beside(Var(pe), tape.project(pe, qkv)), np.nonzero(there)[1]))
    z = tape.add(tape.mul(tape.normalise(tape.attention(item, there, w.heads)), p["user_scale"]), p["user_shift"])
    return tape.pooled(z, tape.matmul(tape.tanh(tape.matmul(z, p["pool"])), p["pool_q"]), there.sum(axis=1))


def _vars(w: Weights) -> dict[str, Var]:
    return {k: Var(v) for k, v in w.params.items()}


def encode_news(w: Weights, x: np.ndarray) -> np.ndarray:
    return _news(w, _vars(w), x).value


def encode_user(w: Weights, h: np.ndarray) -> np.ndarray:
    """User vector of encoded history items `h` (n x size)."""
    return _user(w, _vars(w), Var(h), np.arange(len(h))[None], np.ones((1, len(h)), bool)).value[0]


@dataclass
class Batch:
    """Distinct vectors, the first `n_read` of histories, and the places among them of each impression's history and of its one clicked candidate and the unclicked ones."""

    x: np.ndarray
    n_read: int
    hist: np.ndarray
    in_hist: np.ndarray
    shown: np.ndarray
    in_shown: np.ndarray


def batch_gradient(w: Weights, b: Batch, positive: int = 0) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy of the candidate in column `positive`, summed over the impressions, and the gradients in the order of `Weights.arrays`."""
    p = _vars(w)
    news = _news(w, p, b.x)
    user = _user(w, p, tape.top(news, b.n_read), b.hist, b.in_hist)
    users, m = b.shown.shape
    score = tape.reshape(tape.matmul(tape.take(news, b.shown), tape.reshape(user, users, -1, 1)), users, m)
    chance = tape.softmax(tape.add(score, Var(np.where(b.in_shown, 0, -1e9).astype(b.x.dtype))))
    # The gradient of the cross-entropy goes straight to the scores.
    back = chance.value.copy()
    back[:, positive] -= 1
    tape.backward(score, back)
    return -float(np.log(np.maximum(chance.value[:, positive], 1e-12)).sum()), [np.zeros_like(v.value) if v.grad is None else v.grad for v in p.values()]


def loss_and_gradient(w: Weights, hist: np.ndarray, cands: np.ndarray, positive: int) -> tuple[float, list[np.ndarray]]:
    """The same of one impression."""
    n, m = len(hist), len(cands)
    b = Batch(np.concatenate([hist, cands]), n, np.arange(n)[None], np.ones((1, n), bool), n + np.arange(m)[None], np.ones((1, m), bool))
    return batch_gradient(w, b, positive)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """Random-looking 64-bit numbers made of `parts` (splitmix64)."""
    x = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


class Samples:
    """Impressions: numbers of vectors (-1: none) of their histories and candidates, one after the other, and labels beside the candidates."""

    def __init__(self, vecs: np.ndarray, n_hist: np.ndarray, hist: np.ndarray, n_cand: np.ndarray, cand: np.ndarray, label: np.ndarray, key: np.ndarray | None = None) -> None:
        self.vecs, self.label, self.cand, self.n_cand = vecs, label, cand, n_cand
        known = hist >= 0
        self.hist, self.n_hist = hist[known], np.bincount(np.repeat(np.arange(len(n_hist)), n_hist)[known], minlength=len(n_hist))
        self.key = np.arange(len(n_hist), dtype=np.uint64) if key is None else key
        self.hist_at, self.cand_at = np.cumsum(self.n_hist) - self.n_hist, np.cumsum(self.n_cand) - self.n_cand

    @classmethod
    def of(cls, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dims: int) -> Samples:
        """Of (history, candidates, labels), vectors each."""
        sizes = np.array([(len(h), len(c)) for h, c, _ in samples], int).reshape(-1, 2)
        vecs = np.concatenate([np.reshape(x, (-1, dims)) for h, c, _ in samples for x in (h, c)] or [np.empty((0, dims))])
        start = np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1)
        return cls(vecs, sizes[:, 0], spans(start, sizes[:, 0]), sizes[:, 1], spans(start + sizes[:, 0], sizes[:, 1]), np.concatenate([y for *_, y in samples] or [np.empty(0)]))

    def trainable(self) -> Samples:
        """Only candidates with a vector, and only impressions with a history and both labels."""
        of, n = np.repeat(np.arange(len(self.key)), self.n_cand), len(self.key)
        known = self.cand >= 0
        up, down = (np.bincount(of[known & x], minlength=n) for x in (self.label > 0, self.label == 0))
        good = (self.n_hist > 0) & (up > 0) & (down > 0)
        return Samples(self.vecs, self.n_hist, self.hist, np.bincount(of[known], minlength=n), self.cand[known], self.label[known], self.key).where(good)

    def where(self, good: np.ndarray) -> Samples:
        of_hist, of_cand = (good[np.repeat(np.arange(len(self.key)), n)] for n in (self.n_hist, self.n_cand))
        return Samples(self.vecs, self.n_hist[good], self.hist[of_hist], self.n_cand[good], self.cand[of_cand], self.label[of_cand], self.key[good])

    def joined(self, other: Samples) -> Samples:
        """The impressions of both."""
        vecs, start = (self.vecs, 0) if other.vecs is self.vecs else (np.concatenate([self.vecs, other.vecs]), len(self.vecs))
        hist, cand = (np.concatenate([a, np.where(b < 0, -1, b + start).astype(b.dtype)]) for a, b in ((self.hist, other.hist), (self.cand, other.cand)))
        n_hist, n_cand, label, key = (np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("n_hist", "n_cand", "label", "key"))
        return Samples(vecs, n_hist, hist, n_cand, cand, label, key)

    def histories(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n_hist[rows][:, None]
        at = np.arange(n.max())[None]
        return self.hist[self.hist_at[rows][:, None] + np.where(at < n, at, 0)], at < n

    def batch(self, rows: np.ndarray, epoch: int, negatives: int, seed: int) -> Batch:
        """One clicked and up to `negatives` unclicked candidates of each of `rows`, drawn by their keys."""
        hist, in_hist = self.histories(rows)
        size = self.n_cand[rows]
        at, of = spans(self.cand_at[rows], size), np.repeat(np.arange(len(rows)), size)
        down = self.label[at] == 0
        at = at[np.lexsort((_mixed(seed, epoch, self.key[rows][of], at - self.cand_at[rows][of]), down, of))]  # the clicked ones first
        n_down, first = np.bincount(of[down], minlength=len(rows)), np.cumsum(size) - size
        k = np.arange(1 + min(negatives, n_down.max()))[None]
        there = k <= n_down[:, None]
        place = first[:, None] + np.where((k > 0) & there, (size - n_down)[:, None] + k - 1, 0)
        used, no = np.unique(np.concatenate([hist.ravel(), self.cand[at[place]].ravel()]), return_inverse=True)
        read = np.zeros(len(used), bool)
        read[no[: hist.size]] = True
        number = np.where(read, np.cumsum(read) - 1, read.sum() + np.cumsum(~read) - 1)  # those of histories first
        no = number[no]
        return Batch(self.vecs[np.concatenate([used[read], used[~read]])], int(read.sum()), no[: hist.size].reshape(hist.shape), in_hist, no[hist.size :].reshape(place.shape), there)

    def scores(self, w: Weights, rows: np.ndarray) -> np.ndarray:
        """Of all candidates of `rows`; 0 without a vector or a history."""
        size = self.n_cand[rows]
        cand, of = self.cand[spans(self.cand_at[rows], size)], np.repeat(np.arange(len(rows)), size)
        read = np.flatnonzero(self.n_hist[rows] > 0)
        out, row = np.zeros(len(cand)), np.full(len(rows), -1)
        ok = (cand >= 0) & (self.n_hist[rows] > 0)[of]
        if ok.any():
            row[read] = np.arange(len(read))
            hist, there = self.histories(rows[read])
            used, no = np.unique(np.concatenate([hist.ravel(), cand[ok]]), return_inverse=True)
            news, p = encode_news(w, self.vecs[used]), _vars(w)
            user = _user(w, p, Var(news), no[: hist.size].reshape(hist.shape), there).value
            out[ok] = np.einsum("ij,ij->i", news[no[hist.size :]], user[row[of[ok]]])
        return out

    def auc(self, w: Weights, rows: np.ndarray) -> np.ndarray:
        """Sum of the AUCs of `rows`, which have both labels, and their number."""
        total = 0.0
        for a in range(0, len(rows), CHUNK):
            part = rows[a : a + CHUNK]
            score, end = self.scores(w, part), np.cumsum(self.n_cand[part])
            for r, s in zip(part, np.split(score, end[:-1]), strict=True):
                up = self.label[self.cand_at[r] : self.cand_at[r] + self.n_cand[r]] > 0
                gap = s[up][:, None] - s[~up][None]
                total += ((gap > 0) + 0.5 * (gap == 0)).mean()
        return np.array([total, len(rows)])


def rate_at(step: int, steps: int, rate: float, warmup: float) -> float:
    """Linear warm-up over a share of the steps, then a cosine down to 0; constant without warm-up."""
    if warmup <= 0:
        return rate
    first = max(1, round(steps * warmup))
    return rate * step / first if step <= first else rate * 0.5 * (1 + np.cos(np.pi * (step - first) / max(1, steps - first)))


def sample_auc(w: Weights, samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> float:
    """Mean AUC over the samples that have a history and both labels."""
    x = Samples.of(samples, len(w.params["news"])).trainable()
    total, n = x.auc(w, np.arange(len(x.key)))
    return float(total / n) if n else float("nan")


def learn(x: Samples, held: Samples, size: int = 32, heads: int = 4, epochs: int = 3, **how) -> tuple[Weights, list[float]]:
    """Adam over trainable samples, in steps of about `batch` (by their keys, other ones in each epoch); `total` adds up the arrays of all that learn the same weights of other samples.

    `decay` is decoupled weight decay. `held` samples tell how many epochs are best: those
    after which their AUC was greatest, once it hasn't grown for `patience` epochs. Then
    the weights are learned anew, for so many epochs, from all samples, the held ones too.
    The mean loss of each epoch is returned as well.
    """
    w, means, best = _learned(x, held, size, heads, epochs, epochs, **how)
    if best is not None:
        w, means, _ = _learned(x.joined(held), held.where(np.zeros(len(held.key), bool)), size, heads, epochs, best, **how)
    return w, means


def _learned(
    x: Samples, held: Samples, size: int, heads: int, epochs: int, last: int, negatives: int = 4, rate: float = 1e-3, seed: int = 42, improved: bool = False, positions: bool = False,
    warmup: float = 0.0, decay: float = 0.0, patience: int = 2, batch: int = 1, total: Callable[[np.ndarray], np.ndarray] = lambda x: x,
) -> tuple[Weights, list[float], int | None]:
    """Weights and losses after the `last` of `epochs` (by which the rate goes down), or once the AUC of `held` stops growing, and after how many epochs it was greatest."""
    w = initial(x.vecs.shape[1], size, heads, seed, improved, positions)
    kind = x.vecs.dtype
    flat = np.concatenate([a.ravel() for a in w.arrays()]).astype(kind)
    w.params = {k: part.reshape(v.shape) for (k, v), part in zip(w.params.items(), np.split(flat, np.cumsum([a.size for a in w.arrays()])[:-1]), strict=True)}  # views
    m, s, change, root = (np.zeros_like(flat) for _ in range(4))
    every = np.zeros(len(flat) + 2, kind)
    n, n_held = total(np.array([len(x.key), len(held.key)], float))
    steps = max(1, -(-int(n) // batch))
    step, means, best, stale = 0, [], None, 0
    for epoch in range(last):
        of = (_mixed(seed, 1, epoch, x.key) % np.uint64(steps)).astype(int)
        rows = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=steps))[:-1])
        lost = 0.0
        for own in rows:
            every[:] = 0
            if len(own):
                loss, grads = batch_gradient(w, x.batch(own, epoch, negatives, seed))
                np.concatenate([g.ravel() for g in grads], out=every[:-2])
                every[-2:] = loss, len(own)
            both = total(every)
            if both[-1] == 0:
                continue
            lost += float(both[-2])
            g = both[:-2] * kind.type(1 / both[-1])
            g *= kind.type(min(1.0, 1.0 / max(1e-9, float(np.sqrt(g @ g)))))
            step += 1
            now = rate_at(step, epochs * steps, rate, warmup)
            m *= kind.type(0.9)  # Adam
            m += np.multiply(g, kind.type(0.1), out=change)
            s *= kind.type(0.999)
            s += np.multiply(np.multiply(g, g, out=g), kind.type(0.001), out=g)
            np.sqrt(s, out=root)
            root *= kind.type(1 / np.sqrt(1 - 0.999**step))
            root += kind.type(1e-8)
            np.multiply(m, kind.type(now / (1 - 0.9**step)), out=change)
            change /= root
            if decay:
                flat *= kind.type(1 - now * decay)
            flat -= change
        means.append(float(lost / n) if n else float("nan"))
        if n_held:
            a, b = total(held.auc(w, np.arange(len(held.key))))
            if best is None or a / b > best[0]:
                best, stale = (a / b, epoch + 1), 0
            else:
                stale += 1
            if stale >= patience:
                break
    w.params = {k: v.astype(float) for k, v in w.params.items()}
    return w, means, None if best is None else best[1]


def train(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dims: int, size: int = 32, heads: int = 4, held_out: list | None = None, **how) -> tuple[Weights, list[float]]:
    """`learn` from (history, candidates, labels) samples, vectors each; labels are kept aligned with the candidates."""
    return learn(*(Samples.of(x, dims).trainable() for x in (samples, held_out or [])), size, heads, **how)


def lists(imps: DataFrame, history: DataFrame) -> DataFrame:
    """`impression_id`, history `h`, candidates `c` and their labels `l` of each of `imps`."""
    h = history.groupBy("impression_id").agg(F.flatten(F.sort_array(F.collect_list(F.col("hist.article_id")))).alias("h"))
    cands = F.coalesce("cands", F.array().cast("array<string>"))
    label = F.transform(cands, lambda x: F.coalesce(F.array_contains("clicked", x), F.lit(False)).cast("int"))
    return imps.select("impression_id", cands.alias("c"), label.alias("l")).join(h, "impression_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<string>")))


class _Block:
    """The lists of one task, of which the vectors' names become numbers."""

    def __init__(self, t: pa.Table) -> None:
        (self.n_hist, hist), (self.n_cand, cand), (_, label) = (blocks.lists(t[x]) for x in "hcl")
        self.names = pc.unique(pa.chunked_array([hist, cand], pa.string())).drop_null()
        self.hist, self.cand = (pc.fill_null(pc.index_in(x, value_set=self.names), -1).to_numpy() for x in (hist, cand))
        self.label, self.rows, self.vecs = label.to_numpy().astype(np.int8), np.full(len(self.names), -1), np.empty((0, 1))

    def add_vectors(self, t: pa.Table, kind: type) -> None:
        sizes, names = blocks.lists(t["ids"])
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy()
        used, row = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at >= 0], return_inverse=True)
        self.rows[at[at >= 0]] = row
        vecs = np.ascontiguousarray(blocks.lists(t["vec"])[1].to_numpy().reshape(len(t), -1)[used].astype(kind))
        if len(vecs):  # equal ones once
            _, first, number = np.unique(vecs.view(np.dtype((np.void, vecs[0].nbytes))).ravel(), return_index=True, return_inverse=True)
            self.vecs, self.rows = vecs[first], np.where(self.rows < 0, -1, number[self.rows])

    def samples(self, key: np.ndarray | None = None) -> Samples:
        number = np.append(self.rows, -1).astype(np.int32)  # -1 stays -1
        return Samples(self.vecs, self.n_hist, number[self.hist], self.n_cand, number[self.cand], self.label, key)


def fit(shown: DataFrame, vectors: DataFrame, dims: int, held_out: int | None = None, **how) -> Weights:
    """Learned from all `lists`. With `held_out`, every so many-th impression (by its hash) tells after how many epochs to stop, by weights learned of the others, before all are learned from. A step has 16 to 512 impressions, a thousandth of all in between."""
    shown = written(shown.withColumn("key", F.xxhash64("impression_id", F.lit(5))))
    n = shown.count()

    def fitted(batches: Iterator[pa.RecordBatch], t: Together) -> bytes:
        block, x = None, Samples.of([], dims)
        for _, vb, part in blocks.tables(batches):
            if vb == -1:
                block, key = _Block(part), part["key"].to_numpy().view(np.uint64)
            elif block is not None:
                block.add_vectors(part, np.float32)
        part = None
        if block is not None and len(block.vecs):
            x = block.samples(key).trainable()
        block = None
        x.vecs = x.vecs.astype(np.float32)
        keep = np.ones(len(x.key), bool) if held_out is None else _mixed(7, x.key) % np.uint64(held_out) != 0
        held, x = x.where(~keep), x.where(keep)
        return pickle.dumps(learn(x, held, batch=max(16, min(512, n // 1000)), total=t.sum, **how)[0])

    return pickle.loads(fit_together(shown, "key", n, PER_TASK, fitted, [by_vector(vectors)]))


def score_lists(shown: DataFrame, vectors: DataFrame, w: Weights) -> DataFrame:
    """`impression_id`, `l` and scores `s` beside `c` of each of `lists`; impressions without an encodable history, and candidates without a vector, score 0."""
    q = written(shown)
    n = blocks.n_blocks(q.count(), blocks.KEPT // LISTS, q.sparkSession.sparkContext.defaultParallelism)
    q = q.withColumn("qb", F.pmod(F.xxhash64("impression_id"), F.lit(n)).cast("int"))

    def run(tables: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        block, ids, labels = None, None, None
        for vb, t in tables:
            if vb == -1:
                block, ids, labels = _Block(t), blocks.whole(t["impression_id"]), blocks.whole(t["l"])
            elif block is not None:
                block.add_vectors(t, float)
        if block is None:
            return
        x = block.samples()
        for a in range(0, len(ids), CHUNK):
            rows = np.arange(a, min(a + CHUNK, len(ids)))
            offsets = pa.array(np.append(0, np.cumsum(x.n_cand[rows])), pa.int32())
            s = pa.ListArray.from_arrays(offsets, pa.array(x.scores(w, rows)))
            yield pa.RecordBatch.from_arrays([ids[a : a + CHUNK].cast(pa.string()), labels[a : a + CHUNK], s], names=["impression_id", "l", "s"])

    return blocks.meet(q, [by_vector(vectors)], n, run, "impression_id string, l array<int>, s array<double>")


def score(cands: DataFrame, history: DataFrame, vectors: DataFrame, w: Weights) -> DataFrame:
    """`cands` with `score`; impressions without an encodable history, and candidates without a vector, score 0."""
    listed = cands.groupBy("impression_id").agg(F.sort_array(F.collect_set(F.struct("pos", "article_id"))).alias("x"))
    shown = lists(listed.select("impression_id", F.col("x.article_id").alias("cands"), F.array().cast("array<string>").alias("clicked")), history)
    found = listed.join(score_lists(shown, vectors, w), "impression_id").select("impression_id", F.explode(F.arrays_zip("x", "s")).alias("y"))
    return cands.join(found.select("impression_id", "y.x.pos", "y.x.article_id", F.col("y.s").alias("score")), ["impression_id", "pos", "article_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
