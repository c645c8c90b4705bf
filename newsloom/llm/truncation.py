"""Texts that were cut off: detection by a classifier trained on artificial cuts.

Intact texts of a bounded, hash-chosen sample are cut artificially, at lengths where
their source piles up and at random places, some with a mark of omission
appended; the sample as it stands gives the negatives. A logistic regression over
hashed features of the closing characters, words and punctuation, the last line's
form and the length's place among the source's limits is trained on these and
scores every document. What it needs to know of the corpus (the words that end
sentences, the lengths at which a source piles up) is counted over all documents.

Copies of one text get one verdict: truncated if any of them scores so.

Defined results: null, empty and all-blank texts are not truncated (score 0);
texts of any length are read whole; a null source has no limits; repeated rows
are scored each; with no intact text to train on nothing is found; extra columns
are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.skew import salted_lookup
from newsloom.session import written

#: Natural texts the classifier is fitted on (chosen by hash, so about as many), with an artificial cut of each intact one.
TRAIN_DOCS = 20_000
DIMENSIONS = 2**18
#: A word counts as ending sentences from this share of all sentence ends on, so there are at most 1 / WORD_SHARE of them.
WORD_SHARE = 2e-6
#: Lengths are counted in steps; a step is a limit with this share of its source's texts and this many times its neighbours' mean.
STEP, LIMIT_SHARE, LIMIT_RATIO = 8, 0.015, 4.0
#: Sources with less than this share of all documents have no limits of their own, so there are at most 1 / SOURCE_SHARE with.
SOURCE_SHARE = 1e-4
THRESHOLD = 0.5
#: Share of the artificial cuts within a text's first sentence that are used.
FIRST_SENTENCE = 0.05
#: A natural text scored above this (in log-odds) by the other half's model is no negative example; single sentences, mostly headlines, need more.
SUSPECT, SUSPECT_SINGLE = -1.5, 1.0
#: How often the negatives are cleaned of such texts.
ROUNDS = 2
#: Closing words are a habit if more whole texts of the sample than this have them, and this many times as often as cuts have.
HABIT = 3
#: Up to so many texts (of 17 bytes each) with copies on both sides of the threshold are broadcast; more are met by a join with much-copied ones salted.
BROADCAST_TEXTS = 500_000
#: Marks that are appended where a text is cut.
MARKS = ("…", " …", "...", " ...", " [...]", " (...)")
_MARK = re.compile(r"\s*(?:…|\.\.\.|\[\.\.\.\]|\(\.\.\.\)|\[…\]|\(…\))$")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_END = re.compile(r"[.?!…](?:[\"”“»')\]]|&quot;)*(?=\s|$)")
_DONE = re.compile(r"[.?!](?:[\"”“»]|&quot;)*$")


@dataclass
class Corpus:
    """Facts counted over all documents."""

    enders: dict[str, int]  # word -> how common as a sentence end (1 rare .. 3)
    limits: dict[str, list[int]]  # source -> steps of length at which it piles up
    n_docs: int = 0  # texts that are not null


def shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


def announced(text: str, declared: int | None) -> str:
    """How the length a sender announced compares with the text's."""
    if declared is None or declared != declared:
        return "none"
    n = len(text)
    return "same" if declared == n else "less" if declared < n else "bit" if declared <= n + 12 else "more" if declared <= 1.5 * n else "far"


#: Groups of features that go beyond closing characters, words, punctuation and length: the announced length, the form of the last line, the source's own habits.
SAID, LINE_FORM, OF_SOURCE = {"said", "known said"}, {"first", "lead", "open", "dash", "item", "paren", "digits", "comma", "quote"}, {"src", "named"}


def features(text: str, source: str | None, corpus: Corpus, declared: int | None = None, without: frozenset[str] = frozenset()) -> list[int]:
    """Hashed features of one non-blank text, except those whose name is in `without`; the first stands for its closing words."""
    t = text.rstrip()
    head, _, line = t.rpartition("\n")
    line = line.strip()
    mark = _MARK.search(line)
    core = line[: mark.start()] if mark else line
    words = _WORD.findall(core[-120:])
    w1, w2 = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    first = line.split(" ", 1)[0]
    ends = len(_END.findall(t[:-1]))
    done = bool(_DONE.search(line)) and not mark
    alone = "alone" if not head.strip() else "last"
    sentences = "0" if not ends else "1" if ends == 1 else "2+"
    in_line = "0" if not _END.search(line[:-1]) else "1+"
    known = corpus.enders.get(w1.lower(), 0)
    tail = core[-1:]
    kind = "done" if done else "mark" if mark else "open"
    steps = corpus.limits.get(source or "", [])
    at = len(t) // STEP
    limit = min((abs(at - s) for s in steps), default=9)
    bytes_at = len(t.encode("utf-8", "replace")) // STEP
    limit = "at" if limit <= 1 else "bytes" if min((abs(bytes_at - s) for s in steps), default=9) <= 1 else "no"
    opening = shape(first[:1]) + ("(" if line.startswith("(") else ":" if first.endswith(":") else "")
    said = announced(text, declared)
    colon = line.find(": ")
    lead = line[: colon + 1] if 0 < colon < 24 else ""
    names = [
        f"ww={w2.lower()} {w1.lower()}|{kind}",
        f"k={kind}", f"c={tail}|{kind}", f"t2={core[-2:]}|{kind}", f"t3={line[-3:]}", f"w={w1.lower()}|{kind}", f"s={shape(w1)}|{kind}",
        f"known={known}|{kind}", f"known={known}|{kind}|{alone}|{in_line}", f"lines={alone}|{kind}", f"sent={sentences}|{alone}|{kind}", f"in={in_line}|{alone}|{kind}",
        f"first={first}|{alone}", f"lead={lead}|{kind}", f"open={opening}|{alone}|{kind}", f"limit={limit}|{kind}", f"limit={limit}|{kind}|{known}", f"dash={' - ' in line[-40:]}|{alone}|{kind}",
        f"item={line.startswith('- ')}|{kind}", f"paren={line.endswith(')') and '(' in line}|{line.startswith('(')}", f"digits={bool(re.search(r'[0-9]$', line))}|{bool(re.search('[0-9]+[:.][0-9]+$|[^0-9 ] [0-9]+, [^0-9]+ [0-9]+$', line))}|{in_line}",
        f"len={min(len(t) // 40, 6)}|{kind}|{alone}", f"quote={line.count(chr(34)) % 2}|{kind}", f"bad={'�' in t[-1:]}", f"src={source}|{kind}", f"comma={len(re.findall(', ', line)) > 1}|{lead}|{kind}",
        f"said={said}|{kind}", f"said={said}|{alone}|{in_line}|{kind}", f"named={bool(source) and line.endswith(' - ' + source)}|{in_line}", f"known={known}|{said}|{alone}|{in_line}|{kind}",
    ]
    if without:
        names = [n for n in names if n.split("=", 1)[0] not in without]
    return list(dict.fromkeys(zlib.crc32(n.encode("utf-8", "replace")) % DIMENSIONS for n in names))


def intact(text: str) -> bool:
    """Whether a text surely has its end: its last line ends a sentence, without a mark of omission."""
    t = text.rstrip()
    return bool(_DONE.search(t)) and not t.endswith("...") and len(t) > 40


def cut(text: str, source: str | None, limits: dict[str, list[int]], rng: random.Random, at_limit: bool) -> str | None:
    """An artificial cut of an intact text: at one of its source's limits (if it is that long) or anywhere, in a word or between two, with or without a mark."""
    t = text.rstrip()
    fits = [s * STEP for s in limits.get(source or "", []) if s * STEP < len(t) - STEP]
    at = rng.choice(fits) + rng.randrange(STEP) if fits and at_limit else rng.randrange(20, len(t) - 1)
    body = t[:at]
    if rng.random() < 0.4:
        body = body.rpartition(" ")[0] or body
    if not _END.search(body) and rng.random() > FIRST_SENTENCE:
        return None  # real cuts within the first sentence are rare, headlines standing alone are not
    if rng.random() < 0.3:
        return body.rstrip() + rng.choice(MARKS)
    if rng.random() < 0.05:
        return body + "\ufffd"  # a transfer that ended within a character
    if not body.strip() or _DONE.search(body.rstrip()):
        return None  # cut behind a sentence: nothing tells it from a whole text
    return body


def _descend(data: list[tuple[list[int], float]], rng: random.Random, epochs: int = 5, rate: float = 0.25, l2: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression. Steps shrink with what a feature has seen, so closings that are rare but regular count."""
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    data = [(np.array([*f, DIMENSIONS]), y) for f, y in data]
    for _ in range(epochs):
        rng.shuffle(data)
        for f, y in data:
            v = w[f]
            g = y - 1 / (1 + np.exp(-max(min(v.sum(), 30), -30)))
            seen[f] += g * g
            w[f] = v + rate * (g / np.sqrt(seen[f]) - l2 * v)
    return w


def train(rows: list[tuple[str, str | None, int | None]], corpus: Corpus, seed: int = 5) -> np.ndarray:
    """The final weights; `rows` is (text, source, announced length).

    The sample as it stands also holds truncated texts. So each half is scored by a
    model of the other half, and what looks cut is no negative in the next fit.
    """
    rng = random.Random(seed)
    whole: list[tuple[list[int], float]] = []  # features, the score from which they are suspect
    cuts: list[tuple[list[int], float]] = []
    for text, source, declared in rows:
        if text and text.strip():
            single = not _END.search(text.rstrip()[:-1])
            whole.append((features(text, source, corpus, declared), SUSPECT_SINGLE if single else SUSPECT))
            made = {cut(text, source, corpus.limits, rng, at_limit) for at_limit in (True, False)} if intact(text) else ()
            for c in sorted(c for c in made if c):
                said = None if declared is None else declared if rng.random() < 0.5 else len(c)
                cuts.append((features(c, source, corpus, said), 1.0))
    # A closing seen again and again in whole texts, and more than in cuts, is a habit, not an accident.
    closing, by_cut = Counter(f[0] for f, _ in whole), Counter(f[0] for f, _ in cuts)
    habit = [closing[f[0]] > HABIT and closing[f[0]] * len(cuts) > HABIT * by_cut[f[0]] * len(whole) for f, _ in whole]
    kept = [True] * len(whole)
    for _ in range(ROUNDS):
        looks = list(kept)
        for half in (0, 1):
            w = _descend([(f, 0.0) for (f, _), k in zip(whole[half::2], kept[half::2], strict=True) if k] + cuts[half::2], rng)
            looks[1 - half :: 2] = [h or bool(w[f].sum() + w[-1] < most) for (f, most), h in zip(whole[1 - half :: 2], habit[1 - half :: 2], strict=True)]
        kept = looks
    return _descend([(f, 0.0) for (f, _), k in zip(whole, kept, strict=True) if k] + cuts, rng)


def corpus_facts(docs: DataFrame, text: str, source: str) -> Corpus:
    """The words that end sentences, the lengths at which sources pile up and the number of texts, counted over all documents in one pass."""
    # Only whole words are tried, each once: without the look-behind every suffix of every word would be.
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)[.?!]"), F.lit(1))
    step = F.floor(F.length(F.rtrim(F.col(text), F.lit(" \t\n\x0b\f\r"))) / STEP)
    marks = F.concat(F.transform(words, lambda w: F.struct(F.lower(w).alias("word"), F.lit(None).cast("long").alias("step"))), F.array(F.struct(F.lit(None).cast("string").alias("word"), step.alias("step"))))
    counted = docs.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.explode(marks).alias("m")).select(F.when(F.col("m.word").isNull(), F.col("source")).alias("source"), "m.*")
    counted = written(counted.groupBy("source", "word", "step").agg(F.count(F.lit(1)).alias("n")))
    total, all_docs = (x or 0 for x in counted.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first())
    common = counted.where(F.col("word").isNotNull() & (F.col("n") >= WORD_SHARE * total)).select("word", "n").collect()  # at most 1 / WORD_SHARE
    enders = {r["word"]: 1 + (r["n"] > 20 * WORD_SHARE * total) + (r["n"] > 400 * WORD_SHARE * total) for r in common}

    sizes = counted.where(F.col("word").isNull() & F.col("source").isNotNull()).select("source", "step", "n")
    of_source = Window.partitionBy("source")
    near = Window.partitionBy("source").orderBy("step").rangeBetween(-10, 10)
    sizes = sizes.withColumn("docs", F.sum("n").over(of_source)).withColumn("around", F.sum("n").over(near))
    found = sizes.where((F.col("docs") >= SOURCE_SHARE * all_docs) & (F.col("n") >= 8) & (F.col("n") >= LIMIT_SHARE * F.col("docs")) & (F.col("n") * 20 >= LIMIT_RATIO * (F.col("around") - F.col("n"))) & (F.col("step") >= 12))
    limits: dict[str, list[int]] = {}
    for r in found.select("source", "step").collect():  # at most 1 / LIMIT_SHARE steps a source
        limits.setdefault(r["source"], []).append(r["step"])
    return Corpus(enders, {k: sorted(v) for k, v in limits.items()}, all_docs)


def fit(docs: DataFrame, doc_id: str, text: str, source: str, declared: str | None = None, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, Corpus]:
    corpus = corpus_facts(docs, text, source)
    # A share of the hash range, not the first rows of a sort: no task gathers more than its part of the sample.
    place = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(3)), 11)
    below = F.lit(min(2**53, round(2**53 * train_docs / max(1, corpus.n_docs))))
    picked = docs.where(F.col(text).isNotNull() & (place < below)).select(place.alias("k"), F.col(text), F.col(source), _said(declared))
    rows = sorted(((r[0], r[1], r[2], r[3]) for r in picked.toLocalIterator()), key=lambda r: (r[0], r[1]))
    return train([r[1:] for r in rows], corpus), corpus


def _said(declared: str | None) -> Column:
    return (F.lit(None) if declared is None else F.col(declared)).cast("long").alias("said")


def score(docs: DataFrame, doc_id: str, text: str, source: str, model: tuple[np.ndarray, Corpus], declared: str | None = None) -> DataFrame:
    """`doc_id`, `source`, `h1`, `h2` (two hashes of the text) and `score` of every document."""
    spark: SparkSession = docs.sparkSession
    # DIMENSIONS floats, at most 1 / WORD_SHARE words and 1 / SOURCE_SHARE sources
    shared = spark.sparkContext.broadcast((model[0].astype("float32"), model[1]))
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("h1"), F.crc32(F.encode(text, "UTF-8")).alias("h2"), _said(declared), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, corpus = shared.value
        for b in batches:
            z = [float(w[features(t, s, corpus, n)].sum() + w[-1]) if isinstance(t, str) and t.strip() else -30.0 for t, s, n in zip(b["t"], b["source"], b["said"], strict=True)]
            yield b.drop(columns=["t", "said"]).assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return picked.mapInPandas(run, picked.drop("t", "said").withColumn("score", F.lit(0.0)).schema)


def verdicts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `source`, `score`, `truncated`: a text with a copy that scores at least `threshold` is truncated under every doc_id.

    Copies differ in score only through their sources, so few texts need the
    lookup: those with a copy on either side of the threshold.
    """
    scored = written(scored.withColumn("copy", F.struct("h1", "h2")).drop("h1", "h2"))
    hit = F.col("score") >= threshold
    mixed = written(scored.groupBy("copy").agg(F.max(hit).alias("any"), F.min(hit).alias("every")).where("any and not every").select("copy", "any"))
    if mixed.count() <= BROADCAST_TEXTS:
        both = scored.join(F.broadcast(mixed), "copy", "left")
    else:
        both = salted_lookup(scored, mixed, "copy", "left")
    return both.select("doc_id", "source", "score", F.coalesce("any", hit).alias("truncated"))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Per source: `docs`, `truncated`, `rate`."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("truncated").alias("truncated")).withColumn("rate", F.col("truncated") / F.col("docs"))
