"""Vector codes by integer codebooks, with distances taken in the Walsh-Hadamard domain.

Vectors become integers (``floor(scale * x)``) and are cut into ``n_parts`` equal parts; each part position has a
codebook that rounds of assigning and averaging refine.  The nearest entry is found without floating point: parts and
entries, zero-padded to a power of two L, are transformed by an unnormalised integer Walsh-Hadamard transform, whose
squared differences sum to L times the squared distance.  They are added in sequency order (few sign changes first,
where most of the energy lies); entries whose sum so far is beyond the whole distance of a candidate entry go, the
rest of their terms are never computed.

A round is one job: codebooks (``n_parts`` x ``n_entries`` entries) go out with the tasks, each task adds up its
parts per entry, and one row per task, entry and component comes back to be summed; nothing grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors, and
lengths that ``n_parts`` does not divide, count as padded with zeros; the first entries are those of the smallest ids
(null ids last; rows that repeat an id by their components); fewer rows than entries make fewer entries; rows that
repeat an id keep their own row each; components stop at +-2**62 after scaling and errors at the end of a long; an
empty table gives no rows.
"""

from __future__ import annotations

import decimal
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .threshold_search import LAST, integer_vectors

N_PARTS, N_ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` (a power of two) by their number of sign changes."""
    i = np.arange(size)
    signs = np.array([[bin(r & c).count("1") & 1 for c in i] for r in i])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def transform(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows of ``x``, zero-padded to ``len(order)``, in that order."""
    size = len(order)
    y = np.zeros((len(x), size), x.dtype)
    y[:, :x.shape[1]] = x
    half = 1
    while half < size:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    return y[:, order]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row (ties: the lower index) and the exact squared distance."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    most = max((int(np.abs(a.astype(object)).max()) if a.dtype == object else max(int(a.max()), -int(a.min())) for a in (x, entries) if a.size),
               default=0)
    if (2 * most * size) ** 2 * size >= 1 << 62:  # beyond 64 bits: Python's integers
        x, entries = x.astype(object), entries.astype(object)
    order = sequency_order(size)
    a, c = transform(x, order), transform(entries, order)
    n, k = len(a), len(c)
    first = (a[:, :1] - c[None, :, 0]) ** 2
    guess = first.argmin(1)
    bound = ((a - c[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    held = first[row, entry]
    at, step = 1, 1
    while at < size:
        for s in range(at, at + step):
            held = held + (a[row, s] - c[entry, s]) ** 2
        on = held <= bound[row]
        row, entry, held = row[on], entry[on], held[on]
        at, step = at + step, at + step
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # every row keeps its guess at least
    least = np.minimum.reduceat(held, starts)
    best = np.minimum.reduceat(np.where(held == least[row], entry, k), starts)
    return best, least // size


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their integers in ``width`` columns."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    keep = ~np.isnan(sizes.astype(float))
    sizes = np.where(keep, sizes, 0).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    keep &= np.bincount(of, ~np.isfinite(flat), len(sizes)) == 0
    with np.errstate(all="ignore"):
        ints = np.clip(np.floor(flat * scale), -2.0 ** 62, 2.0 ** 62)
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = keep[of]
    out[of[ok], place[ok]] = ints[ok].astype(np.int64)
    return np.flatnonzero(keep), out[keep]


def _totals(books: np.ndarray, width: int, scale: int):
    """Per task: sums and counts of the parts that each entry is nearest to."""
    n_parts, n_entries, w = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, object), np.zeros((n_parts, n_entries), np.int64)
        for b in batches:
            _, x = _integers(b.column(0), width, scale)
            if not len(x):
                continue
            wide = object if max(int(x.max()), -int(x.min())) * len(x) >= 1 << 62 else np.int64
            for p in range(n_parts):
                part = x[:, p * w:(p + 1) * w]
                code, _ = nearest(part, books[p])
                one = np.zeros((n_entries, w), wide)
                np.add.at(one, code, part.astype(wide))
                total[p] += one.astype(object)
                count[p] += np.bincount(code, minlength=n_entries)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(p, w)), pa.array(np.repeat(e, w)), pa.array(np.tile(np.arange(w), len(p))),
                pa.array([decimal.Decimal(int(v)) for v in total[p, e].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count[p, e], w))],
                ["part", "entry", "at", "total", "n"])
    return run


def _coder(books: np.ndarray, width: int, scale: int):
    n_parts, _, w = books.shape

    def run(batches):
        for b in batches:
            rows, x = _integers(b.column(0), width, scale)
            if not len(x):
                continue
            codes, error = np.zeros((len(x), n_parts), np.int64), np.zeros(len(x), object)
            for p in range(n_parts):
                codes[:, p], d = nearest(x[:, p * w:(p + 1) * w], books[p])
                error += d.astype(object)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([
                b.column(1).take(at), b.column(2).take(at), pa.array(["".join("%02x" % c for c in r) for r in codes.tolist()]),
                pa.array([min(int(e), LAST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def codebooks(rows: DataFrame, n_parts: int = N_PARTS, n_entries: int = N_ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
              id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """Entries as (part, entry, component) integers after all rounds; None where no row takes part."""
    ints = integer_vectors(rows, scale, id_col, vector_col)
    start = [r["v"] for r in ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(n_entries).collect()]
    if not start:
        return None
    width = max(ints.agg(F.max(F.size("v")).alias("w")).first()["w"], 1)
    w = -(-width // n_parts)
    books = np.zeros((len(start), n_parts * w), np.int64)
    for i, v in enumerate(start):
        books[i, :len(v)] = v
    books = np.ascontiguousarray(books.reshape(len(start), n_parts, w).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = rows.select(vector_col).mapInArrow(_totals(books, n_parts * w, scale),
                                                  "part long, entry long, at long, total decimal(38,0), n long")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # one row per component of the codebooks
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray | None, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of the rows that take part."""
    of = rows.select(F.col(vector_col).alias("x"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"))
    schema = f"vec_id long, label {of.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    return of.mapInArrow(_coder(books, books.shape[0] * books.shape[2], scale), schema)


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``approx``: the entries that the codes name, as one integer vector."""
    w = books.shape[2]

    def run(batches):
        for b in batches:
            codes = b.column(b.schema.get_field_index("code")).to_pylist()
            at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), books.shape[0])
            flat = books[np.arange(books.shape[0]), at].reshape(-1)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * (w * books.shape[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                             [*b.schema.names, "approx"])
    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", approx array<long>")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, **sizes) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows that take part."""
    books = codebooks(rows, **sizes)
    coded = cut_lineage(encode(rows, books, sizes.get("scale", SCALE)))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"))
    sums = sums.select(F.col("label").alias("of"), F.least("e", F.lit(LAST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    # one row per label: adaptive execution broadcasts it when it is small and splits a hot label when not
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))
