"""Toxicity by subword bags.

A word is the mean of the vectors of its byte n-grams (hashed to buckets), a window of words the mean of its words,
and a linear softmax tells toxic windows; embeddings and softmax are trained jointly in numpy on a bounded sample of
labelled rows.  A window begins at every word, so what stands before a phrase does not move it from one window to
another.  A text is as toxic as its most toxic window, so a long text does not water an insult down, and a misspelling
shares most n-grams with words that were seen.

Defined results: null, empty and blank texts have no window and score the model's bias; without labelled rows of both
kinds every score is the bias.  Every whole text is scored, row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Chunk, chunks, mix

BUCKETS = 1 << 18
DIM = 4
WINDOW = 2
#: In bytes: a stem of four letters with accents has eight.
SIZES = (3, 4, 5, 6, 7)
#: Labelled rows of each class that the model is fitted on, in hash order, and the longest text among them.
SAMPLE_ROWS = {1: 1200, 0: 2000}
SAMPLE_BYTES = 8_000
THRESHOLD = 0.7


class Model:
    """The softmax is linear, so for scoring a bucket's vector counts as one number."""

    def __init__(self, pull: np.ndarray, bias: float):
        self.pull, self.bias = pull.astype(np.float64), float(bias)


def ngrams(c: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the given words, with a mark before and after each, and the word of each."""
    n = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(n)), n)
    inside = np.arange(at[-1]) - at[word]
    raw = np.full(at[-1], 1, np.uint64)
    body = (inside > 0) & (inside < n[word] - 1)
    raw[body] = c.data[starts[word[body]] + inside[body] - 1].astype(np.uint64) + np.uint64(2)
    out, of = [], []
    h = np.zeros(at[-1], np.uint64)
    for k in range(max(SIZES)):
        h[:len(h) - k] = h[:len(h) - k] * np.uint64(0x100000001B3) + raw[k:]
        if k + 1 in SIZES:
            on = np.flatnonzero(inside + k < n[word])
            out.append((mix(h[on] + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            of.append(word[on].astype(np.int32))
    return np.concatenate(out), np.concatenate(of)


class Windows:
    """The windows of rows of words: one begins at every word that has WINDOW - 1 more after it, and at a row's first
    word, where a shorter row counts as if it were filled with neutral words.  A word counts once in a window, so
    repeating it does not shout."""

    def __init__(self, doc: np.ndarray, which: np.ndarray):
        self.n = len(doc)
        order = np.lexsort((np.arange(self.n), which, doc))
        again = (which[order][1:] == which[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        before = np.full(self.n, -1, np.int64)  # the same word's last place in the row
        before[order[1:][again]] = order[:-1][again]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(first, self.n))
        end, begin = np.repeat(first + size, size), np.repeat(first, size)
        at = np.arange(self.n)
        self.start = np.flatnonzero((at + WINDOW <= end) | (at == begin))
        self.row = doc[self.start]
        self.place, self.counts = [], []
        for k in range(WINDOW):
            at = np.minimum(self.start + k, max(self.n - 1, 0))
            self.place.append(at.astype(np.int32))
            self.counts.append((self.start + k < end[self.start]) & (before[at] < self.start))
        del order, again, before, end, begin

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per window, the sum over its words of a number per place."""
        return sum((np.where(on, x[at], 0) for at, on in zip(self.place, self.counts)), np.zeros(len(self.start), x.dtype))

    def spread(self, g: np.ndarray) -> np.ndarray:
        """Per place, the sum over the windows that count it of a number per window."""
        return sum((np.bincount(at, np.where(on, g, 0), self.n) for at, on in zip(self.place, self.counts)), np.zeros(self.n))


def _distinct(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = c.words()
    _, first, which = np.unique(c.span_hashes(starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], which, doc


def _gathered(index: np.ndarray, value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``bincount(index, value[of], n)`` in steps that bound the memory in between."""
    out = np.zeros(n)
    for at in range(0, len(index), 1 << 20):
        out += np.bincount(index[at:at + (1 << 20)], value[of[at:at + (1 << 20)]], n)
    return out


def train(texts: list[str], labels: np.ndarray, rounds: int = 120, rate: float = 0.6, seed: int = 5, last: int = 40) -> Model:
    """Full-batch descent on the cross entropy of each text's pooled windows, both classes weighing the same; the pool
    starts near the mean of the windows and sharpens to the strongest.  A step is scaled by the largest gradient of its
    table, so what many texts share moves first and what one text happens to hold hardly moves; the model is the mean of
    those after the ``last`` rounds.

    The softmax is linear, so a window's logit is the mean of one number per word, and the gradient of a bucket's vector
    is one number times the softmax's difference: nothing with DIM columns is ever kept per word or place."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    softmax = np.repeat(np.array([[-0.5, 0.5]], np.float32), DIM, 0) + rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    c = Chunk(None, LOWER[np.frombuffer(b"".join(raw), np.uint8)], offs)
    starts, ends, which, doc = _distinct(c)
    if not len(which) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -2.0)
    bucket, word = ngrams(c, starts, ends)
    n_words = len(starts)
    per_word = np.bincount(word, minlength=n_words)
    windows = Windows(doc, which)
    row_at = np.flatnonzero(np.diff(windows.row, prepend=-1))
    index = np.repeat(np.arange(len(row_at)), np.diff(np.append(row_at, len(windows.row))))
    y = labels[windows.row[row_at]].astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    moving = [np.zeros_like(p) for p in (vectors, softmax, bias)]
    pulls, biases = np.zeros(BUCKETS), 0.0
    for step in range(rounds):
        apart = softmax[:, 1] - softmax[:, 0]
        pull = _gathered(word, vectors @ apart, bucket, n_words) / per_word
        z = windows.sums(pull[which]) / WINDOW + (bias[1] - bias[0])
        sharp = 0.1 + 6.0 * step / rounds
        e = np.exp(sharp * (z - np.maximum.reduceat(z, row_at)[index]))
        share = e / np.add.reduceat(e, row_at)[index]
        pooled = np.add.reduceat(share * z, row_at)
        p = 1 / (1 + np.exp(-np.clip(pooled, -60, 60)))
        g = ((p - y) * weight)[index] * share
        of_word = np.bincount(which, windows.spread(g) / WINDOW, n_words) / per_word
        of_bucket = _gathered(bucket, of_word, word, BUCKETS).astype(np.float32)
        gain = of_bucket @ vectors
        grads = of_bucket[:, None] * apart[None], np.stack([-gain, gain], 1), np.array([-g.sum(), g.sum()])
        for k, (p_, g_) in enumerate(zip((vectors, softmax, bias), grads)):
            moving[k] = 0.9 * moving[k] + g_
            p_ -= (rate * (1, 0.05, 0.2)[k] * moving[k] / (np.abs(moving[k]).max() + 1e-12)).astype(np.float32)
        if step >= rounds - last:
            pulls += vectors @ (softmax[:, 1] - softmax[:, 0])
            biases += float(bias[1] - bias[0])
    return Model(pulls / min(last, rounds), biases / min(last, rounds))


def score_rows(c: Chunk, model: Model) -> np.ndarray:
    starts, ends, which, doc = _distinct(c)
    top = np.full(c.n, -np.inf)
    if len(which):
        bucket, word = ngrams(c, starts, ends)
        pulls = np.bincount(word, model.pull[bucket], len(starts)) / np.bincount(word, minlength=len(starts))
        windows = Windows(doc, which)
        np.maximum.at(top, windows.row, windows.sums(pulls[which]) / WINDOW)
    top[np.isneginf(top)] = 0.0
    return 1 / (1 + np.exp(-np.clip(top + model.bias, -60, 60)))


def _scorer(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for c in chunks(batches, lower=True):
            yield pa.RecordBatch.from_arrays([c.rows.column("doc_id"), c.rows.column("held_out"), pa.array(score_rows(c, model))],
                                             ["doc_id", "held_out", "score"])
    return run


def held_out(doc_id="doc_id"):
    """Rows that the model never learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a sample of labelled rows (``SAMPLE_ROWS``), not held out, in the order of a hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("toxic").isin(0, 1) & F.col("of").isNotNull()).where(~held_out("of")).distinct()
    ids = None
    for label, n in SAMPLE_ROWS.items():
        part = own.where(F.col("toxic") == label).orderBy(F.xxhash64("of"), "of").limit(n)
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES) \
        .join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("of"))
    rows = rows.groupBy("of", "toxic").agg(F.max("text").alias("text")).collect()  # at most the sample's rows
    rows.sort(key=lambda r: (r["of"], r["toxic"]))
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], int))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # one number per bucket
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(_scorer(told), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
