"""Shared helpers: table access, bounded Arrow chunks and vectorised byte-level words.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; those bytes never occur inside a multi-byte
UTF-8 character, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; it is installed at the same path on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def has_unique_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, kept for the next call of this worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Chunk:
    """The texts of some rows as one byte array: ``data`` and ``offs`` (row i is ``data[offs[i]:offs[i + 1]]``)."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, data: np.ndarray, offs: np.ndarray):
        self.rows, self.data, self.offs, self.n = rows, data, offs, len(offs) - 1
        self._sums: np.ndarray | None = None

    def spans(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every maximal run of bytes for which ``keep`` holds, inside rows."""
        if not len(keep):
            z = np.zeros(0, np.int64)
            return z, z, z
        full = np.flatnonzero(self.offs[1:] > self.offs[:-1])
        before = np.empty_like(keep)
        before[0] = False
        before[1:] = keep[:-1]
        before[self.offs[full]] = False
        starts = np.flatnonzero(keep & ~before)
        after = np.empty_like(keep)
        after[-1] = False
        after[:-1] = keep[1:]
        after[self.offs[full + 1] - 1] = False
        ends = np.flatnonzero(keep & ~after) + 1
        return starts, ends, np.searchsorted(self.offs, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, from prefix sums of a polynomial with an odd (so invertible) base."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_BASE, n + 1)[:n], out=self._sums[1:])
        inverse = powers(_BASE_INV, len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def per_row(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, self.n).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False,
           limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts Arrow batches into runs of whole rows of about ``limit`` bytes of text (null counts as empty); a longer
    text is a chunk of its own, so memory is bounded by the limit or the longest single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = pc.fill_null(col.cast(pa.large_string() if not pa.types.is_large_binary(col.type) else col.type), "")
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            own = data[offs[at]:offs[to]]
            yield Chunk(batch.slice(at, to - at), LOWER[own] if lower else own, offs[at:to + 1] - offs[at])
            at = to


def repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over rows (group, key): ``later`` marks rows equal to an earlier row, ``many`` rows whose pair occurs twice or
    more."""
    n = len(key)
    later, many = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.lexsort((key, group))
        same = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
        later[order[1:]] = same  # lexsort is stable: the first of equal rows is the earliest
        many[order[1:]] |= same
        many[order[:-1]] |= same
    return later, many
