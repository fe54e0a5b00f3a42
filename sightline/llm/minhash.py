"""Near-duplicate components by b-bit MinHash.

Every document's set of word shingles gives ``BANDS * ROWS`` minima.  Bands of full minima make candidate buckets;
of each minimum only ``BITS`` low bits are kept, packed, and candidates whose collision-corrected estimate (by bit
counts) cannot be a link are dropped; the rest are confirmed on the full sets.  Documents with equal sets are one
class and meet once.

Buckets never become all their pairs: each member first meets the least leader of its buckets; components of those
links are made; only buckets that still hold several components compare members, in blocks of bounded size.  A first
pass over packed minima tells which members have a partner near the threshold in another component; their full sets
then come to the same blocks, and only links that join components leave them.

Defined results: null and blank texts have an empty set, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle; rows that share a doc_id are one document with several texts (a null
doc_id is a document of its own); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .common import Chunk, chunks, has_unique_ids, mix
from .components import connected_components

SHINGLE = 4
PERCENT = 80
BANDS, ROWS, BITS = 36, 5, 4
#: Standard deviations of the estimate below the threshold at which a candidate is dropped.
SIGMAS = 4.5
#: Members of a block; a group compared in one task holds two blocks.
BLOCK = 256
#: Bytes of text that a worker signs at a time.
PIECE_BYTES = 1 << 19
NO_ID = -(1 << 63)
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every row, sorted, one row after the other, and the rows' bounds."""
    starts, ends, doc = c.words()
    h = c.span_hashes(starts, ends)
    n = c.per_row(doc)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1]) if len(h) >= width else np.zeros(0, np.int64)
    got = np.zeros(len(at), np.uint64)
    for k in range(width):
        got = mix(got + h[at + k] + np.uint64(k + 1))
    rows = doc[at]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            on = n[short] > k
            extra[on] = mix(extra[on] + h[first[short[on]] + k] + np.uint64(101 + k))
        got, rows = np.concatenate([got, extra]), np.concatenate([rows, short])
    order = np.lexsort((got, rows))
    got, rows = got[order], rows[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (rows[1:] != rows[:-1])
    got, rows = got[new], rows[new]
    return got, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=c.n))]).astype(np.int64)


def _pack(low: np.ndarray) -> np.ndarray:
    """Rows of BITS-bit values as packed 64-bit words."""
    per = 64 // BITS
    pad = -low.shape[1] % per
    low = np.pad(low, ((0, 0), (0, pad))).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), 2)


_ONES = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))


def estimate(a: np.ndarray, b: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Similarity from packed minima (last axis: words): the share of equal values, corrected for the 2 ** -BITS of
    unequal minima whose low bits agree."""
    x = a ^ b
    differ = x
    for i in range(1, BITS):
        differ = differ | (x >> np.uint64(i))
    unequal = np.bitwise_count(differ & _ONES).sum(-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return (1 - unequal / k - chance) / (1 - chance)


def floor_estimate(percent: int = PERCENT, k: int = BANDS * ROWS) -> float:
    chance = 2.0 ** -BITS
    equal = percent / 100 * (1 - chance) + chance
    return percent / 100 - SIGMAS * (equal * (1 - equal) / k) ** 0.5 / (1 - chance)


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, lower=True, limit=PIECE_BYTES):
            sets, at = shingle_sets(c, width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            minima = np.zeros((c.n, BANDS * ROWS), np.uint64)
            if len(full):
                for j, factor in enumerate(_FACTORS):
                    minima[full, j] = np.minimum.reduceat(sets * factor, at[full])
            bands = np.zeros((c.n, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands + minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(ROWS) + np.uint64(r))
            packed = _pack(mix(minima) & np.uint64((1 << BITS) - 1))
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays([
                c.rows.column("doc_id"), pa.array(n),
                pa.array([hashlib.blake2b(raw[8 * x:8 * y], digest_size=16).digest() for x, y in zip(at[:-1], at[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * c.n + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64))),
                pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "sig"])
    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, lower=True, limit=PIECE_BYTES):
            sets, at = shingle_sets(c, width)
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays([
                c.rows.column("doc_id"), pa.array([raw[8 * x:8 * y] for x, y in zip(at[:-1], at[1:])], pa.binary())], ["node", "members"])
    return run


def _words(col: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def _near(least: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = estimate(_words(b.column("sig_a")), _words(b.column("sig_b"))) >= least
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are a link."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                  for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups of equal (key, i, j); rows arrive sorted by these."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        last = [t.column(c)[-1].as_py() for c in ("key", "i", "j")]
        open_ = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
        cut = int(np.flatnonzero(~open_)[-1]) + 1 if (~open_).any() else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def _cross(t: pa.Table, percent: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different components inside each group of ``t`` that lengths and estimate allow to be links."""
    key, i, j, blk, component, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "blk", "component", "n"))
    sig = _words(t.column("sig"))
    same = (key[1:] == key[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [t.num_rows]])
    for s, e in zip(cuts[:-1], cuts[1:]):
        left = np.arange(s, e)[blk[s:e] == i[s]]
        right = left if i[s] == j[s] else np.arange(s, e)[blk[s:e] == j[s]]
        for at in range(0, len(left), 64):
            own = left[at:at + 64]
            small, large = n[own][:, None], n[right][None]
            x, y = np.nonzero((component[own][:, None] != component[right][None])
                              & (100 * np.minimum(small, large) >= percent * np.maximum(small, large)))
            x, y = own[x], right[y]
            if i[s] == j[s]:
                x, y = x[x < y], y[x < y]
            if len(x):
                near = estimate(sig[x], sig[y]) >= least
                yield x[near], y[near]


def _suspects(percent: int, least: float):
    """The rows with a partner that may be a link, looked at in the first band that both share."""
    def run(batches):
        for t in _groups(batches):
            bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
            key = t.column("key").to_numpy()
            hit = np.zeros(t.num_rows, bool)
            for x, y in _cross(t, percent, least):
                first = (bands[x] == bands[y]).argmax(1)
                here = bands[x, first] == key[x]
                hit[x[here]] = hit[y[here]] = True
            for b in t.drop_columns(["bands"]).filter(pa.array(hit)).to_batches():
                yield b
    return run


def _block_links(percent: int, least: float):
    """Confirmed links between different components inside each group; links that only join what the group's links
    join already are not told."""
    def run(batches):
        for t in _groups(batches):
            node, component = t.column("node").to_numpy(), t.column("component").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
            root: dict[int, int] = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x
            out = []
            for xs, ys in _cross(t, percent, least):
                for x, y in zip(xs.tolist(), ys.tolist()):
                    p, q = find(component[x]), find(component[y])
                    if p != q and _linked(sets[x], sets[y], percent):
                        root[max(p, q)] = min(p, q)
                        out.append((node[x], node[y]))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    signed = cut_lineage(ids.mapInArrow(_signer(width), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"))
    classes = cut_lineage(signed.where("n_shingles > 0").groupBy("digest")
                          .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sig")).alias("m"))
                          .select("digest", F.col("m.doc_id").alias("node"), F.col("m.n_shingles").alias("n"), "m.bands", "m.sig"))
    by_band = classes.select("node", F.explode("bands").alias("key"))
    leads = by_band.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut_lineage(by_band.join(leads.drop("size"), "key"))
    least = floor_estimate(percent)
    sigs = classes.select("node", "n", "sig")
    members = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(ids.join(members, "doc_id", "left_semi").mapInArrow(_set_maker(width), "node long, members binary"))

    def near(pairs: DataFrame) -> DataFrame:
        x = sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a"))
        y = sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b"))
        both = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_near(least), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        return cut_lineage(pairs.join(x, "a").join(y, "b").mapInArrow(_confirm(percent), "a long, b long").distinct())

    # each member with the first of its buckets' leaders
    met = buckets.groupBy("node").agg(F.min("lead").alias("a")).where("node <> a").select("a", F.col("node").alias("b"))
    links = confirmed(near(met))
    found = connected_components(links)
    # buckets that still hold several components
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut_lineage(placed.select("key", "node", "component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    open_ = open_.where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(open_, "key").join(classes.select("node", "n", "sig", "bands"), "node")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "node", "component", "n", "sig", "blk", "bands", other)
    rows = rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "component",
                       "n", "sig", "bands")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    suspects = cut_lineage(rows.mapInArrow(_suspects(percent, least), rows.drop("bands").schema))
    full = suspects.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = connected_components(links.union(full.mapInArrow(_block_links(percent, least), "a long, b long")))
    release(sets, buckets, placed, suspects, links)  # the components are stored
    first = found.groupBy("component").agg(F.min("node").alias("component_id"))
    found = found.join(first, "component").select("node", "component_id")
    # every row by its class, then by its class's component
    named = signed.select("doc_id", "n_shingles", "digest").join(
        classes.select("digest", "node").join(found, "node", "left")
        .select("digest", F.coalesce("component_id", "node").alias("component_id")), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    named = named.withColumn("component_id", component)
    return named.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles",
                        F.nullif("component_id", F.lit(NO_ID)).alias("component_id"),
                        (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when one document of each component stays: that with the smallest
    doc_id, and of rows repeating it, one.  Rows without a doc_id of their own are numbered in a stored table first."""
    if has_unique_ids(docs):
        told = near_duplicates(docs.select("doc_id", "text"), width, percent).where("kept").select(F.col("doc_id").alias("id"))
        marked = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))
        return marked.join(told, "id", "left_semi").select("doc.*")
    marked = cut_lineage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row_no")))
    told = near_duplicates(marked.select(F.col("row_no").alias("doc_id"), "doc.text"), width, percent)
    told = told.select(F.col("doc_id").alias("row_no"), "component_id")
    ids = marked.select("row_no", "doc.doc_id")
    stay = told.join(ids, "row_no").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_no")).alias("m")).select("m.row_no")
    return marked.join(stay, "row_no", "left_semi").select("doc.*")
