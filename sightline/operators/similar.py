"""Exact similarity search between line vectors (rows 27-29, 51, 62, 64, 100, 107).

Metric partitioning, no all-pairs rows and no cross join:

* pivots are a seeded sample of the references (about the square root of their number, bounded in bytes); every
  reference belongs to the cell of its nearest pivot; cells are numbered so that close-by ones follow each other;
* a cell's references, in order of their distance to the pivot, are cut into blocks of bounded size and stored once,
  one packed row per block, with the block's smallest and largest distance to the pivot (``ReferenceCells``); ranges
  of (cell, distance) are what tasks get, so a cell that holds a third of all references is many blocks in many tasks;
* consecutive blocks make groups of ``GROUP_BYTES``; a query is sent once to every group with a block that can hold
  something within its radius: by the triangle inequality a reference at pivot distance t is at least
  ``|d(query, pivot) - t|`` away, and no closer than half of what its pivot is farther than the query's nearest pivot;
* a task reads a group's blocks, then the group's queries in order of their nearest cell, and compares runs of queries
  with the blocks that the bound leaves, nearest first.  For an even p the sum of (x - y)^p is a matrix product of
  powers, which picks the candidates (in single precision, with a bound of its rounding error); their distances are
  then computed one by one as everywhere else;
* the k nearest take two rounds: the k-th best distance among as many close-by references as are needed for k, then
  everything within that radius.

Distances are double; ties are broken by reference id everywhere.  Bounds are widened by a rounding allowance, so
pruning never drops a pair.  Rows whose vector is null, or holds a null or a NaN, are never similar to anything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import metric_p
from ..session import cut_lineage
from .ordering import cpu_partitions

BLOCK_BYTES = 1 << 20
PIVOT_BYTES = 1 << 24
#: Bytes of the references that a task compares with all queries sent to them.
GROUP_BYTES = 1 << 24
#: Tasks that the queries of one group, or of one block in the first round of the k nearest, are dealt over.
SALTS, HOME_SALTS = 16, 4
#: Queries that are compared with a block at once; pairs whose coordinates are compared at once.
RUN = 512
TILE_PAIRS = 1 << 14
#: Allowance for rounding in distances and bounds, relative.
SLACK = 1e-9

_BLOCK = "block long, cell int, lo double, hi double, n int, ids binary, m binary"
_ROUTED = "query_id long, cell int, d double, near double, radius double, q binary"
_SENT = "g long, cell int, id long, radius double, q binary"
_PAIRS = "query_id long, ref_id long, distance double"


def distances(q: np.ndarray, r: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances (queries x references), folded dimension by dimension like a SQL fold; in tiles that stay in
    a core's cache."""
    out = np.zeros((len(q), len(r)))
    qt, rt = np.ascontiguousarray(q.T), np.ascontiguousarray(r.T)
    wide = min(max(len(r), 1), 2048)
    high = max(1, TILE_PAIRS // wide)
    for i in range(0, len(q), high):
        for j in range(0, len(r), wide):
            acc = out[i:i + high, j:j + wide]
            part = np.zeros(acc.shape)
            d, e = np.empty(acc.shape), np.empty(acc.shape)
            for x, y in zip(qt[:, i:i + high], rt[:, j:j + wide]):
                np.subtract(x[:, None], y[None, :], out=d)
                _fold(part, d, e, p)
            acc[...] = part
    return _root(out, p)


def _fold(acc: np.ndarray, d: np.ndarray, e: np.ndarray, p: float) -> None:
    """One dimension's differences ``d`` added to ``acc``; ``d`` and ``e`` are overwritten."""
    np.abs(d, out=d)
    if math.isinf(p):
        np.maximum(acc, d, out=acc)
        return
    if p == 2:
        np.multiply(d, d, out=d)
    elif p == 6:
        np.multiply(d, d, out=d)
        np.multiply(d, d, out=e)
        np.multiply(e, d, out=d)
    elif p != 1:
        np.power(d, p, out=d)
    acc += d


def _root(acc: np.ndarray, p: float) -> np.ndarray:
    return acc if math.isinf(p) or p == 1 else acc ** (1.0 / p)


def pair_distances(q: np.ndarray, r: np.ndarray, p: float) -> np.ndarray:
    """Distances of each row of ``q`` to the same row of ``r``, bit by bit those of ``distances``."""
    out = np.empty(len(q))
    for i in range(0, len(q), TILE_PAIRS):
        diff = np.ascontiguousarray((q[i:i + TILE_PAIRS] - r[i:i + TILE_PAIRS]).T)
        acc, e = np.zeros(diff.shape[1]), np.empty(diff.shape[1])
        for d in diff:
            _fold(acc, d, e, p)
        out[i:i + TILE_PAIRS] = acc
    return _root(out, p)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _usable(df: DataFrame, id_col: str, *more: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *more) \
        .where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


class ReferenceCells:
    """References cut into cells and stored blocks, for any number of joins.

    ``blocks``: the stored table; ``pivots``: the pivots' matrix; ``counts``, ``lo``, ``hi``: references, smallest and
    largest pivot distance per cell (as many rows as pivots, which are bounded in bytes); ``groups``: the group of every
    block."""

    def __init__(self, refs: DataFrame, metric=None, ref_block: int | None = None, pivots: int | None = None, seed: int = 0,
                 group_bytes: int | None = None):
        self.p = metric_p(metric)
        if self.p < 1:
            raise ValueError("a Minkowski distance with p < 1 is no metric")
        rows = _usable(refs, "ref_id")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
        self.n, self.width = seen["n"], seen["width"] or 1
        most = max(1, PIVOT_BYTES // (8 * self.width))
        self.pivots = self._choose(rows, min(most, pivots or math.isqrt(max(self.n - 1, 0)) + 1), seed)
        size = ref_block or max(1, BLOCK_BYTES // (8 * self.width))
        parts = cpu_partitions(refs)
        placed = rows.mapInArrow(_placer(self.pivots, self.p), "cell int, d double, id long, x binary")
        placed = placed.repartitionByRange(parts, "cell", "d", "id").sortWithinPartitions("cell", "d", "id")
        self.blocks = cut_lineage(placed.mapInArrow(_block_packer(size), _BLOCK.replace("block long, ", ""))
                                  .select(F.monotonically_increasing_id().alias("block"), "*"))
        # one row per block of up to BLOCK_BYTES, no vectors
        told = sorted((r["cell"], r["lo"], r["hi"], r["block"], r["n"]) for r in self.blocks.select("cell", "lo", "hi", "block", "n").collect())
        k = max(len(self.pivots), 1)
        self.counts, self.lo, self.hi = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf)
        rows = 0
        #: per block its cell, bounds and id; the places where groups begin
        self.of_cell, self.block_lo, self.block_hi = (np.array([t[i] for t in told], kind) for i, kind in ((0, np.int64), (1, float), (2, float)))
        self.starts, most = [], max(1, (group_bytes or GROUP_BYTES) // (8 * self.width))
        for i, (cell, lo, hi, _, n) in enumerate(told):
            self.counts[cell] += n
            self.lo[cell], self.hi[cell] = min(self.lo[cell], lo), max(self.hi[cell], hi)
            if not self.starts or rows + n > most:
                self.starts.append(i)
                rows = 0
            rows += n
        group = np.searchsorted(self.starts, np.arange(len(told)), "right") - 1
        self.groups = refs.sparkSession.createDataFrame([(t[3], int(g)) for t, g in zip(told, group)], "block long, g long")

    def _choose(self, rows: DataFrame, n: int, seed: int) -> np.ndarray:
        h = F.xxhash64(F.lit(seed), F.col("id"))
        found = rows.orderBy(h, "id").select("x").limit(n).collect() if self.n else []
        own = np.unique(np.array([r["x"] for r in found], np.float64).reshape(-1, self.width), axis=0)
        return own[_near_order(own)]

    def directory(self) -> DataFrame:
        return self.blocks.select("block", F.col("cell").alias("of"), "lo", "hi", "n")


def _near_order(points: np.ndarray) -> np.ndarray:
    """An order in which points that are close by mostly follow each other: halved again and again along the widest
    coordinate."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) < 3:
            out.extend(own)
            continue
        at = points[own]
        own = own[np.argsort(at[:, np.ptp(at, axis=0).argmax()], kind="stable")]
        stack += [own[len(own) // 2:], own[:len(own) // 2]]
    return np.array(out, np.int64)


def _placer(pivots: np.ndarray, p: float):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1), pivots.shape[1])
                d = distances(x, pivots, p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), part.column(0),
                    pa.array([v.tobytes() for v in x], pa.binary())], ["cell", "d", "id", "x"])
    return run


def _block_packer(size: int):
    """Rows in order of (cell, distance): runs of at most ``size`` rows of one cell, inside in order of their ids."""
    def pack(cell, d, ids, xs):
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([
            pa.array([cell], pa.int32()), pa.array([min(d)], pa.float64()), pa.array([max(d)], pa.float64()), pa.array([len(ids)], pa.int32()),
            pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([b"".join(xs[i] for i in order)], pa.binary())],
            ["cell", "lo", "hi", "n", "ids", "m"])

    def run(batches):
        now, d, ids, xs = None, [], [], []
        for b in batches:
            for cell, dist, i, x in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (cell != now or len(ids) >= size):
                    yield pack(now, d, ids, xs)
                    d, ids, xs = [], [], []
                now = cell
                d.append(dist)
                ids.append(i)
                xs.append(x)
        if ids:
            yield pack(now, d, ids, xs)
    return run


def _router(cells: ReferenceCells, k: int):
    """Per query the cells it must see: with ``k`` the closest that hold ``k`` references, else all within its radius."""
    pivots, p, lo, hi, counts = cells.pivots, cells.p, cells.lo, cells.hi, cells.counts

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1), pivots.shape[1])
                radius = part.column(2).to_numpy(zero_copy_only=False)
                d = distances(x, pivots, p)
                near = d.min(1)
                if k:
                    order = np.argsort(d, axis=1, kind="stable")
                    held = np.cumsum(counts[order], axis=1)
                    reach = np.zeros(d.shape, bool)
                    np.put_along_axis(reach, order, held - counts[order] < k, axis=1)
                    reach &= counts > 0
                else:
                    r = radius[:, None] + SLACK * (d + hi + radius[:, None] + 1e-300)
                    reach = (counts > 0) & (d - r <= hi) & (d + r >= lo) & (d - near[:, None] <= 2 * r)
                row, cell = np.nonzero(reach)
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(d[row, cell]), pa.array(near[row]),
                    pa.array(radius[row]), raw.take(pa.array(row))], ["query_id", "cell", "d", "near", "radius", "q"])
    return run


def _group_router(cells: ReferenceCells):
    """Per query one row for every group with a block that can hold something within its radius."""
    pivots, p, of_cell, lo, hi, starts = cells.pivots, cells.p, cells.of_cell, cells.block_lo, cells.block_hi, cells.starts

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1), pivots.shape[1])
                radius = part.column(2).to_numpy(zero_copy_only=False)
                d = distances(x, pivots, p)
                reach = _reach(d, d.min(1), radius, of_cell, lo, hi)
                row, group = np.nonzero(np.logical_or.reduceat(reach, starts, axis=1))
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(group), pa.array(d.argmin(1).astype(np.int32)[row]), part.column(0).take(pa.array(row)),
                    pa.array(radius[row]), raw.take(pa.array(row))], ["g", "cell", "id", "radius", "q"])
    return run


def _reach(d, near, radius, of_cell, lo, hi) -> np.ndarray:
    """Whether a query with distances ``d`` to the pivots can have something within its radius in each block."""
    d = d[:, of_cell]
    r = radius[:, None] + SLACK * (d + hi + radius[:, None] + 1e-300)
    return (d - r <= hi) & (d + r >= lo) & (d - near[:, None] <= 2 * r) | ~np.isfinite(d)


class _Group:
    """References of a group's blocks in a task.  For an even p also their powers, beside which those of the queries
    make the sums of (x - y)^p one matrix product."""

    def __init__(self, p: float, width: int):
        self.p, self.width, self.cell, self.lo, self.hi, self.ids, self.m = p, width, [], [], [], [], []

    def add(self, cell: int, lo: float, hi: float, ids: bytes, m: bytes) -> None:
        self.cell.append(cell)
        self.lo.append(lo)
        self.hi.append(hi)
        self.ids.append(np.frombuffer(ids, np.int64))
        self.m.append(np.frombuffer(m, np.float64).reshape(-1, self.width))

    def close(self) -> None:
        self.cell, self.lo, self.hi = np.array(self.cell, np.int64), np.array(self.lo), np.array(self.hi)
        self.powers = None
        top = max((np.abs(m).max(initial=0) for m in self.m), default=0)
        if self.p in (2, 4, 6) and 0 < top < 1e30:
            self.scale, p = 2.0 ** -math.ceil(math.log2(top)), int(self.p)
            self.powers, self.size = [], []
            for m in self.m:
                up = _powers(m * self.scale, p)
                self.powers.append(np.hstack([*up[-2::-1], np.ones((len(m), 1)), up[-1].sum(1)[:, None]]).astype(np.float32))
                self.size.append(float(up[-1].sum(1).max() ** (1 / p)))

    def run(self, q: np.ndarray):
        """The queries' side of the products and how far these may be from the sums; nothing where that is not known."""
        if self.powers is None:
            return None
        x, p = q * self.scale, int(self.p)
        if not np.abs(x).max(initial=0) <= 4:
            return None
        up = _powers(x, p)
        whole = up.pop().sum(1)
        own = np.hstack([math.comb(p, k) * (-1) ** k * v for k, v in enumerate(up, 1)] + [whole[:, None], np.ones((len(x), 1))])
        return own.astype(np.float32), whole ** (1 / p), ((p - 1) * self.width + 32) * 1.2e-7


def _powers(x: np.ndarray, p: int) -> list[np.ndarray]:
    up = [x]
    while len(up) < p:
        up.append(up[-1] * x)
    return up


def _found(group: _Group, pivots: np.ndarray, k: int, prune: bool, ids, radius, q):
    """Pairs of a run of queries and a group within each query's radius, with ``k`` at least the first ``k`` by
    (distance, id)."""
    p, n = group.p, len(q)
    side = group.run(q)
    power = 1 if math.isinf(p) else p
    scale = group.scale if side is not None else 1.0
    with np.errstate(over="ignore"):
        most = ((radius * (1 + SLACK) * scale) ** power if side is not None else radius.copy())
    best = np.full((n, k), np.inf) if k else None
    d = distances(q, pivots[np.unique(group.cell)], p) if prune else None
    of = np.searchsorted(np.unique(group.cell), group.cell)
    order = np.argsort(d.mean(0)[of], kind="stable") if prune else range(len(group.m))
    kept = []
    for i in order:
        m = group.m[i]
        if prune:
            now = most if not k else np.minimum(most, best[:, -1])
            r = now ** (1 / power) / scale if side is not None else now
            own = np.flatnonzero(_reach(d, np.full(n, np.inf), r, of[i:i + 1], group.lo[i], group.hi[i])[:, 0])
            if not len(own):
                continue
        else:
            own = np.arange(n)
        if side is None:
            s, off = distances(q[own], m, p), np.zeros(len(own))
        else:
            s = side[0][own] @ group.powers[i].T
            off = side[2] * (side[1][own] + group.size[i]) ** p + 1e-36
        bound = most[own] if not k else np.minimum(most[own], best[own, -1])
        row, col = np.nonzero(s <= (bound + off)[:, None])
        if not len(row):
            continue
        s = s[row, col].astype(np.float64)
        if k:  # upper bounds of the k best so far
            at = np.lexsort((s, row))
            first = np.searchsorted(row[at], np.arange(len(own)))
            place = np.arange(len(at)) - first[row[at]]
            few = at[place < k]
            block = np.full((len(own), k), np.inf)
            block[row[few], place[place < k]] = s[few] + off[row[few]]
            best[own] = np.sort(np.hstack([best[own], block]), axis=1)[:, :k]
        kept.append((own[row], np.full(len(row), i), col, s - off[row]))
        if not k:
            yield from _told(group, kept, ids, radius, q)
            kept = []
    if kept:
        kept = [tuple(np.concatenate(c) for c in zip(*kept))]
        last = kept[0][3] <= best[kept[0][0], -1]
        yield from _told(group, [tuple(c[last] for c in kept[0])], ids, radius, q, k)


def _told(group: _Group, kept, ids, radius, q, k: int = 0):
    """Candidates with their distances, those within the radius, with ``k`` each query's first."""
    for row, block, col, _ in kept:
        cut = np.flatnonzero(np.diff(block)) + 1
        refs, ends = [], [0, *cut, len(block)]
        for a, z in zip(ends, ends[1:]):
            if z > a:
                refs.append((group.ids[block[a]][col[a:z]], pair_distances(q[row[a:z]], group.m[block[a]][col[a:z]], group.p)))
        if not refs:
            continue
        ref, dist = (np.concatenate(x) for x in zip(*refs))
        on = np.flatnonzero(dist <= radius[row])
        if k:
            on = on[np.lexsort((ref[on], dist[on], row[on]))]
            on = on[np.arange(len(on)) - np.searchsorted(row[on], row[on]) < k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[on]]), pa.array(ref[on]), pa.array(dist[on])], ["query_id", "ref_id", "distance"])


def _meeting(p: float, width: int, pivots: np.ndarray, k: int, prune: bool, size: int):
    """Rows of each (g, salt): the blocks, then the queries in order of their nearest cell, compared run by run."""
    def run(batches):
        now, group, open_, held = None, None, False, []

        def met():
            ids, radius, q = zip(*held)
            yield from _found(group, pivots, k, prune, np.array(ids, np.int64), np.array(radius, np.float64),
                              np.frombuffer(b"".join(q), np.float64).reshape(-1, width))

        for b in batches:
            for g, salt, cell, i, radius, lo, hi, blob, m in zip(*(b.column(c) for c in ("g", "salt", "cell", "id", "radius", "lo", "hi", "ids", "m"))):
                if (g.as_py(), salt.as_py()) != now:
                    if held:
                        yield from met()
                    now, group, open_, held = (g.as_py(), salt.as_py()), _Group(p, width), True, []
                if i.as_py() is None:
                    group.add(int(radius.as_py()), lo.as_py(), hi.as_py(), blob.as_buffer().to_pybytes(), m.as_buffer().to_pybytes())
                    continue
                if open_:
                    group.close()
                    open_ = False
                held.append((i.as_py(), radius.as_py(), m.as_py()))
                if len(held) >= size:
                    yield from met()
                    held = []
        if held:
            yield from met()
    return run


def reference_cells(refs, metric=None, **sizes) -> ReferenceCells:
    """``refs`` (``ref_id, embedding``) as cells; cells that are there already are used as they are."""
    return refs if isinstance(refs, ReferenceCells) else ReferenceCells(refs, metric, **sizes)


def routed(queries: DataFrame, cells: ReferenceCells, k: int = 0) -> DataFrame:
    """(block, query_id, radius, q): the blocks that each query (``query_id, embedding, radius``) is copied to."""
    rows = _usable(queries, "query_id", "radius")
    sent = rows.mapInArrow(_router(cells, k), _ROUTED)
    both = sent.join(cells.directory(), F.col("cell") == F.col("of"))
    gap = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0))
    if k:  # only as many blocks of the closest cells as hold k references
        w = Window.partitionBy("query_id").orderBy("gap", "d", "block").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("gap", gap).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < k)
    else:
        both = both.where(gap <= F.col("radius") + SLACK * (F.col("d") + F.col("hi") + F.col("radius")))
    return both.select("block", "query_id", "radius", "q")


def near_pairs(queries: DataFrame, cells: ReferenceCells, k: int = 0, home: bool = False, query_block: int | None = None) -> DataFrame:
    """(query_id, ref_id, distance) within each query's ``radius``; with ``k`` at least the ``k`` first of them by
    (distance, id).  ``home``: only among the blocks closest to the query that hold ``k`` references."""
    if not cells.n:
        return queries.sparkSession.createDataFrame([], _PAIRS)
    parts = cpu_partitions(queries)
    salts = HOME_SALTS if home else SALTS
    if home:
        sent = routed(queries, cells, k).select(F.col("block").alias("g"), F.lit(0).alias("cell"), F.col("query_id").alias("id"), "radius", "q")
        blocks = cells.blocks.withColumn("g", F.col("block"))
    else:
        sent = _usable(queries, "query_id", "radius").mapInArrow(_group_router(cells), _SENT)
        blocks = cells.blocks.join(F.broadcast(cells.groups), "block")  # a number per block
    none = lambda kind: F.lit(None).cast(kind)
    asked = sent.select("g", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "cell", "id", "radius",
                        none("double").alias("lo"), none("double").alias("hi"), none("binary").alias("ids"), F.col("q").alias("m"))
    # every task of a group reads its blocks first: cell -1, no id, the cell in place of the radius
    held = blocks.select("g", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).alias("cell"), none("long").alias("id"),
                         F.col("cell").cast("double").alias("radius"), "lo", "hi", "ids", "m")
    both = held.unionByName(asked).repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "cell", "id")
    return both.mapInArrow(_meeting(cells.p, cells.width, cells.pivots, k, not home, query_block or RUN), _PAIRS)


def _rank(df: DataFrame, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id")))


def knn_join(queries: DataFrame, refs, k: int, metric=None, query_block: int | None = None, **sizes) -> DataFrame:
    """Row 28: the ``k`` nearest references of each query (ties: smaller ref id)."""
    cells = reference_cells(refs, metric, **sizes)
    anywhere = queries.select("query_id", "embedding", F.lit(float("inf")).alias("radius"))
    home = _rank(near_pairs(anywhere, cells, k, True, query_block)).where(F.col("rank") <= k)
    # the k-th best of the first round; a query with fewer references than k must see them all
    reach = home.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    reach = cut_lineage(reach.select("query_id", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("radius")))
    within = queries.select("query_id", "embedding").join(reach, "query_id")
    out = _rank(near_pairs(within, cells, k, False, query_block)).where(F.col("rank") <= k)
    return out.select("query_id", "ref_id", "distance", "rank")


def radius_join(queries: DataFrame, refs, radius: float, max_similar: int | None = None, metric=None,
                query_block: int | None = None, **sizes) -> DataFrame:
    """Row 27: every reference with ``distance <= radius``, nearest first, at most ``max_similar`` (row 62 ranks them)."""
    cells = reference_cells(refs, metric, **sizes)
    asked = queries.select("query_id", "embedding", F.lit(radius).cast("double").alias("radius"))
    out = _rank(near_pairs(asked, cells, max_similar or 0, False, query_block))
    if max_similar is not None:
        out = out.where(F.col("rank") <= max_similar)
    return out.select("query_id", "ref_id", "distance", "rank")


def nearest_line(queries: DataFrame, refs, metric=None, **sizes) -> DataFrame:
    """Row 64: the single nearest reference (min by (distance, ref id))."""
    return knn_join(queries, refs, 1, metric, **sizes).select("query_id", "ref_id", "distance")


def cutoff_sample(refs: DataFrame, sample: int | None, seed: int = 0) -> DataFrame:
    """Q21 fixed: a seeded hash sample of ``sample`` references (top-n by md5); None: all."""
    if sample is None:
        return refs
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("ref_id").cast("string")))
    return refs.withColumn("_h", h).orderBy("_h").limit(sample).drop("_h")


def exact_quantile(df: DataFrame, value: str, q: float, bins: int = 4096, few: int = 1 << 16) -> float | None:
    """The ``q`` quantile with linear interpolation, by selection: values are counted in equal ranges between the
    smallest and the largest, and the range that holds the wanted place is refined until it holds ``few`` values or
    one.  Counts per range, then those values, come back."""
    held = cut_lineage(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")))
    low, high, n = held.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    place = q * (n - 1)
    first, before, above, inside = math.floor(place), 0, high, n  # ``above``: the least value beyond the range
    while low < high and inside > few:
        width = high - low
        part = held.where((F.col("v") >= low) & (F.col("v") <= high))
        ranges = part.groupBy(F.least(F.floor((F.col("v") - low) / width * bins), F.lit(bins - 1)).alias("b")) \
            .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for i, r in enumerate(ranges):  # one row per range
            if before + r["n"] > first:
                low, high, inside = r["low"], r["high"], r["n"]
                above = ranges[i + 1]["low"] if i + 1 < len(ranges) else above
                break
            before += r["n"]
    if low < high:
        values = sorted(r["v"] for r in held.where((F.col("v") >= low) & (F.col("v") <= high)).collect())
        at, beyond = values[first - before], first + 1 - before < len(values) and values[first + 1 - before]
    else:
        at, beyond = low, first + 1 - before < inside and low
    return at + ((above if beyond is False else beyond) - at) * (place - first)


def similarity_cutoff(refs: DataFrame, percentile: float = 50, sample: int | None = None, seed: int = 0,
                      metric=None, cells: ReferenceCells | None = None, **sizes) -> float | None:
    """Row 51: distance of each reference (or of a seeded ``sample`` of them) to its 2nd nearest reference (itself
    being the 1st), and the ``percentile`` of those (linear interpolation)."""
    s = cutoff_sample(refs, sample, seed).select(F.col("ref_id").alias("query_id"), "embedding")
    cells = cells or reference_cells(refs, metric, **sizes)
    return exact_quantile(knn_join(s, cells, 2).where(F.col("rank") == 2), "distance", percentile / 100.0)


def similar_pairs(queries: DataFrame, refs, cut_off: float | None, max_similar: int | None = None,
                  at_least_one_result: bool = True, metric=None, query_block: int | None = None, **sizes) -> DataFrame:
    """Row 29 core: per query, references within the cut-off (at most ``max_similar``);
    with ``at_least_one_result`` the nearest when none qualifies (Q20 fixed: without a
    cut-off, the ``max_similar`` nearest)."""
    if cut_off is None and max_similar is None:
        raise ValueError("without a cut-off, max_similar must say how many references to return")
    cells = reference_cells(refs, metric, **sizes)
    if cut_off is None:
        return knn_join(queries, cells, max_similar, query_block=query_block)
    hit = radius_join(queries, cells, cut_off, max_similar, query_block=query_block)
    if not at_least_one_result:
        return hit
    hit = cut_lineage(hit)
    lonely = queries.select("query_id", "embedding").join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return hit.unionByName(knn_join(lonely, cells, 1, query_block=query_block))
