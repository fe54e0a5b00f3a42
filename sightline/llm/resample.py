"""Importance resampling towards a target distribution over hashed n-gram buckets, by a head-tail vocabulary.

A feature is a run of 1 to ``n`` consecutive words joined by one space; its bucket is the CRC-32 of its bytes modulo
``buckets``.  Most words of a text are among few frequent ones: the CRC-32 states of the ``HEAD`` most frequent words
and the buckets of the ``HEAD`` most frequent pairs of them go to every task (bounded by ``HEAD``); a run that starts
with a known word goes on from its state, and whatever is not in the head takes its CRC directly.  Both ways give the
same buckets, so the head decides speed only; bucket totals are exact counts over all texts.

Texts are read twice: once to find the head, once to store each document's buckets (two bytes a feature).  Totals,
gains (one integer per bucket) and weights come from the stored buckets.  The draw numbers documents by score with
range partitions and per-partition counts, so no task and not the driver sees them all.

Defined results: null text has no features; a null doc_id draws its number as the empty string and ranks after others
of equal score; rows that repeat a doc_id are rows of their own; texts without words have weight 0; an empty table
gives no rows; an empty target gives the gains of t = T = 0.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import cut_lineage, release
from .common import Chunk, chunks, mix

HEAD = 1 << 15
#: Words or pairs that a task counts at a time while it looks for frequent ones; more only sharpens the head.
COUNTED = 1 << 18
BUCKETS = 10_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs from the hash of the run before the last word and that word's hash."""
    return mix(a * _STEP + b)


class _Words:
    """Words of a chunk: spans, rows and 64-bit hashes."""

    def __init__(self, c: Chunk):
        self.start, self.end, self.row = c.spans(_IN_WORD[c.data])
        self.hash = c.span_hashes(self.start, self.end)
        self.raw = c.data.tobytes()

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]]

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words."""
        at = np.arange(max(len(self.row) - n + 1, 0))
        return at[self.row[at] == self.row[at + n - 1]]


def _frequent(pairs: bool):
    """Per task: frequent words (or pairs of words) with counts; counts below the least are dropped when there are too
    many, so memory is bounded."""
    def run(batches):
        held: dict[bytes, int] = {}
        for c in chunks(batches, lower=True):
            w = _Words(c)
            at = w.runs(2 if pairs else 1)
            keys = _joined(w.hash[at], w.hash[at + 1]) if pairs else w.hash
            _, first, n = np.unique(keys, return_index=True, return_counts=True)
            for i, k in zip(at[first].tolist(), n.tolist()):
                x = w.word(i) + b" " + w.word(i + 1) if pairs else w.word(i)
                held[x] = held.get(x, 0) + k
            if len(held) > 2 * COUNTED:
                least = np.partition(np.fromiter(held.values(), np.int64, len(held)), -COUNTED)[-COUNTED]
                held = {x: k for x, k in held.items() if k > least}
        top = sorted(held.items(), key=lambda t: (-t[1], t[0]))[:HEAD]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.binary()), pa.array([k for _, k in top], pa.int64())], ["run", "k"])
    return run


def head_runs(docs: DataFrame, pairs: bool = False, size: int = HEAD) -> list[bytes]:
    """At most ``size`` frequent words or pairs, most frequent first; of all counted, those with at least one in
    ``16 * size`` places, so at most ``16 * size`` meet in the selection however many tasks count."""
    found = docs.select("text").mapInArrow(_frequent(pairs), "run binary, k long").groupBy("run").agg(F.sum("k").alias("k"))
    found = cut_lineage(found)
    total = found.agg(F.sum("k")).first()[0] or 0  # one scalar
    often = found.where(F.col("k") * (16 * size) >= total)
    rows = often.orderBy(F.col("k").desc(), "run").limit(size).collect()
    release(found)
    return [bytes(r["run"]) for r in rows]


class Buckets:
    """Buckets of the runs of a chunk, from the head where it knows a run and from the bytes where not."""

    def __init__(self, words: list[bytes], pairs: list[bytes], n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.words = self._sorted([(self._hash(w), zlib.crc32(w)) for w in words])
        self.pairs = self._sorted([(self._hash(p), zlib.crc32(p)) for p in pairs])

    @staticmethod
    def _hash(run: bytes) -> int:
        w = _Words(Chunk(None, np.frombuffer(run, np.uint8), np.array([0, len(run)])))
        return int(w.hash[0]) if len(w.hash) == 1 else int(_joined(w.hash[:1], w.hash[1:2])[0])

    @staticmethod
    def _sorted(rows):
        rows = sorted(dict(rows).items())
        return np.array([h for h, _ in rows], np.uint64), np.array([s for _, s in rows], np.uint32)

    @staticmethod
    def _known(table, keys):
        hashes, states = table
        at = np.minimum(np.searchsorted(hashes, keys), max(len(hashes) - 1, 0))
        hit = hashes[at] == keys if len(hashes) else np.zeros(len(keys), bool)
        return hit, states[at] if len(states) else np.zeros(len(keys), np.uint32)

    def of(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every feature of the chunk."""
        w = _Words(c)
        rows, out = [], []
        before = keys = None
        for n in range(1, self.n + 1):
            at = w.runs(n)
            full = w.hash if n == 1 else _joined(keys[at], w.hash[at + n - 1])
            found, first, which = np.unique(full, return_index=True, return_inverse=True)
            hit, state = self._known(self.words if n == 1 else self.pairs if n == 2 else (np.zeros(0, np.uint64), np.zeros(0, np.uint32)), found)
            state = state.copy()
            for i in np.flatnonzero(~hit).tolist():  # the tail: bytes of this run, once per chunk
                word = w.word(int(at[first[i]]) + n - 1)
                state[i] = zlib.crc32(word) if n == 1 else zlib.crc32(b" " + word, int(before[at[first[i]]]))
            states = state[which]
            rows.append(w.row[at])
            out.append(states % np.uint32(self.buckets))
            before, keys = np.zeros(len(w.row), np.uint32), np.zeros(len(w.row), np.uint64)
            before[at], keys[at] = states, full
        return np.concatenate(rows), np.concatenate(out)


def _bucketed(head: Buckets):
    kind = np.dtype("<u2" if head.buckets <= 1 << 16 else "<u4")

    def run(batches):
        for c in chunks(batches, lower=True):
            rows, found = head.of(c)
            order = np.lexsort((found, rows))
            raw = found[order].astype(kind).tobytes()
            n = np.bincount(rows, minlength=c.n)
            to = np.cumsum(n) * kind.itemsize
            n_words = np.bincount(c.spans(_IN_WORD[c.data])[2], minlength=c.n) if head.n > 1 else n
            yield pa.RecordBatch.from_arrays([
                c.rows.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                pa.array([raw[s:e] for s, e in zip(to - n * kind.itemsize, to)], pa.binary())], ["doc_id", "n_words", "n_features", "found"])
    return run, kind


def _counted(kind, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "k"])
    return run


def _weighed(kind, gains: np.ndarray):
    def run(batches):
        for b in batches:
            x = b.column(b.schema.get_field_index("found"))
            weight = [int(gains[np.frombuffer(v.as_buffer(), kind)].sum()) for v in x]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])
    return run


def bucket_totals(coded: DataFrame, kind, buckets: int) -> np.ndarray:
    """Exact number of features per bucket; one row per bucket comes back."""
    rows = coded.select("found").mapInArrow(_counted(kind, buckets), "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k"))
    total = np.zeros(buckets, object)
    for r in rows.collect():
        total[r["bucket"]] = r["k"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n = len(source)
    s_all, t_all = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t) + 1) * float(s_all) / ((float(s) + 1) * float(t_all))))
                     for s, t in zip(source, target)], np.int64)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20,
             percent: int = 10, head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, ... for the drawn, by falling score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = Buckets(head_runs(docs, False, head), head_runs(docs, True, head) if n > 1 else [], n, buckets)
    run, kind = _bucketed(table)
    schema = "doc_id long, n_words long, n_features long, found binary"
    coded = cut_lineage(docs.mapInArrow(run, schema))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    gain = gains(bucket_totals(coded, kind, buckets), bucket_totals(wanted, kind, buckets))
    weighed = coded.mapInArrow(_weighed(kind, gain), "doc_id long, n_words long, n_features long, weight long")
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"),
                            (F.col("n_words") >= min_words).alias("fit"))
    placed = dense_index(scored, [~F.col("fit"), -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features"),
                                  F.col("weight")], "rank", 1)
    fit = coded.where(F.col("n_words") >= min_words).count()
    drawn = percent * fit // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
