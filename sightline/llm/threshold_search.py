"""Exact top-k inner products by the three-phase uniform threshold.

Vectors become integers (``floor(scale * x)``) and equal vectors are one object with its smallest ids, so a group of
copies is scored once.  The components are cut into ``parts`` runs; each run is a list of its own, stored in blocks
of packed rows.  A query's score of an object is the sum of its scores in the lists.

1. every list gives each query's ``k + 1`` best partial scores; their exact totals give a cutoff that so many objects
   reach;
2. the cutoff goes back to the lists; an object above it must have more than ``cutoff / parts`` in some list (or
   exactly that in all), so each list gives all entries of at least that;
3. objects whose known and largest possible missing scores fall short go; what is missing is computed from the vectors.

Objects are ordered by score, then by smallest id, and cutoffs are places in that order, so equal scores do not
widen a list.  Query blocks meet list blocks in an equi-join on (list, block); only packed blocks travel.

Defined results: rows whose vector is null or holds null or non-finite components take no part; shorter vectors count
as padded with zeros; rows that repeat an id are rows of their own (a query leaves out one row with its id and
vector); null ids come after all others and are no queries; scores beyond a long stop at its ends; fewer candidates
than ``k`` are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import cpu_partitions
from ..session import cut_lineage

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LAST = (1 << 63) - 1

_PACKED = "part int, block int, n int, nodes binary, firsts binary, tau binary, tau_first binary, m binary"
_LISTED = "q long, node long, first long, part int, partial decimal(38,0)"


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array<long>) of the rows that take part; components stop at +-2**62."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    end = F.lit(float(1 << 62))
    ints = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), end), -end)))
    return rows.select(F.col(id_col).cast("long").alias("id"), wide.alias("x")) \
        .where(F.col("x").isNotNull() & ~bad).select("id", ints.alias("v"))


def to_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of long lists as an int64 matrix of ``width`` columns, short rows padded with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(np.asarray(column.offsets))
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _largest(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T``: in doubles while every sum is exact there, else in 64 bits, else in Python's integers."""
    bound = _largest(a) * _largest(b) * max(a.shape[1], 1)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def row_products(a: np.ndarray, b: np.ndarray) -> list[int]:
    if _largest(a) * _largest(b) * max(a.shape[1], 1) < 1 << 62:
        return (a * b).sum(1).tolist()
    return (a.astype(object) * b.astype(object)).sum(1).tolist()


def _pack(width: int, parts: int):
    """One block of rows as ``parts`` packed rows, smallest first id first."""
    cuts = np.linspace(0, width, parts + 1).astype(int)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("first", "ascending"), ("node", "ascending")]).combine_chunks()
        m = to_matrix(t.column("v").combine_chunks(), width)
        col = {c: t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "first", "tau", "tau_first")}
        block = t.column("block")[0].as_py()
        rows = [{"part": p, "block": block, "n": len(m), "nodes": col["node"], "firsts": col["first"], "tau": col["tau"],
                 "tau_first": col["tau_first"], "m": np.ascontiguousarray(m[:, cuts[p]:cuts[p + 1]]).tobytes()}
                for p in range(parts)]
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("nodes", pa.binary()), ("firsts", pa.binary()),
            ("tau", pa.binary()), ("tau_first", pa.binary()), ("m", pa.binary())]))
    return run


def _packed(vectors: DataFrame, blocks: int, width: int, parts: int) -> DataFrame:
    cols = {"tau": F.lit(0), "tau_first": F.lit(0)} | {c: F.col(c) for c in ("tau", "tau_first") if c in vectors.columns}
    rows = vectors.select("node", "first", "v", *[c.cast("long").alias(n) for n, c in cols.items()],
                          F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    return cut_lineage(rows.groupBy("block").applyInArrow(_pack(width, parts), _PACKED))


def _longs(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), np.int64)


def _pairs_of(batch: pa.RecordBatch):
    """Per joined row: part, object and query columns, and the partial scores of all of them (objects x queries)."""
    for r in range(batch.num_rows):
        at = lambda name: _longs(batch, name, r)
        nodes, q = at("nodes"), at("q_nodes")
        scores = products(at("m").reshape(len(nodes), -1), at("q_m").reshape(len(q), -1))
        yield batch.column(0)[r].as_py(), nodes, at("firsts"), q, at("q_tau"), at("q_tau_first"), scores


def _listed(q, nodes, firsts, part, scores) -> pa.RecordBatch:
    import decimal
    value = pa.array([decimal.Decimal(int(x)) for x in scores], pa.decimal128(38, 0)) if scores.dtype == object \
        else pa.array(scores).cast(pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(nodes), pa.array(firsts), pa.array(np.full(len(q), part, np.int32)),
                                       value], ["q", "node", "first", "part", "partial"])


def _best(k: int):
    """Phase 1 in a block: the ``k`` best of every query, of equal scores those with the smallest first ids."""
    def run(batches):
        for b in batches:
            for part, nodes, firsts, q, _, _, s in _pairs_of(b):
                n = len(nodes)
                top = min(k, n)
                if s.dtype != object and _largest(s) < (1 << 62) // n:
                    key = s * n + np.arange(n)[::-1, None]  # rows are in order of their first ids
                    at = np.argpartition(key, n - top, axis=0)[n - top:]
                else:
                    at = np.argsort(-s, axis=0, kind="stable")[:top]
                cols = np.broadcast_to(np.arange(len(q)), at.shape).ravel()
                at = at.ravel()
                yield _listed(q[cols], nodes[at], firsts[at], part, s[at, cols])
    return run


def _reaching(parts: int):
    """Phase 2 in a block: all entries that a query's uniform threshold lets through."""
    def run(batches):
        for b in batches:
            for part, nodes, firsts, q, tau, tau_first, s in _pairs_of(b):
                if s.dtype != object and _largest(s) >= (1 << 62) // parts:
                    s = s.astype(object)
                m = s * parts
                at, cols = np.nonzero((m > tau) | ((m == tau) & (firsts[:, None] <= tau_first)))
                yield _listed(q[cols], nodes[at], firsts[at], part, s[at, cols])
    return run


def _score_rows(batches):
    for b in batches:
        a, c = (b.column(b.schema.get_field_index(x)) for x in ("v", "q_v"))
        width = max((int(np.diff(np.asarray(x.offsets)).max()) if len(x) else 0 for x in (a, c)), default=0)
        scores = row_products(to_matrix(a, width), to_matrix(c, width))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(
            [min(max(x, -LAST - 1), LAST) for x in scores], pa.int64())], ["q", "node", "first", "score"])


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, node, first, score) of (q, node, first) rows, from the vectors."""
    v = vectors.select("node", "v")
    both = pairs.select("q", "node", "first").join(v, "node").join(v.select(F.col("node").alias("q"), F.col("v").alias("q_v")), "q")
    return both.select("q", "node", "first", "v", "q_v").mapInArrow(_score_rows, "q long, node long, first long, score long")


def _top(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows per key; Spark cuts each task's rows to ``k`` per key before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, parts: int = 2, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query row among all other rows, equal
    scores in order of ids.  ``is_query`` is a condition on ``id``, the row's id."""
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    ints = integer_vectors(rows, scale, id_col, vector_col).withColumn("h", F.xxhash64("v"))
    keep = k + 1  # a query's own row may be among them
    by_id = F.struct(F.col("id").isNull().alias("unknown"), "id")
    few = _top(ints.withColumn("by", by_id), ["h", "v"], [F.col("by")], keep)
    groups = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("by")).alias("ids"))
    first = F.coalesce(F.col("ids")[0]["id"], F.lit(LAST))
    objects = cut_lineage(groups.select("h", "v", "ids", first.alias("first"), F.monotonically_increasing_id().alias("node")))
    seen = objects.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not seen["n"]:
        return spark.createDataFrame([], out)
    width = max(seen["width"], 1)
    parts = min(parts, width)
    asked = ints.where(F.col("id").isNotNull() & is_query).select("id", "h", F.col("v").alias("q_v"))
    keys = objects.select("h", F.col("v").alias("q_v"), F.col("node").alias("q"))
    asked = cut_lineage(asked.join(keys, ["h", "q_v"]).select(F.col("id").alias("query_id"), "q"))
    wanted = cut_lineage(objects.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi").select("node", "first", "v"))
    n_wanted = wanted.count()
    if not n_wanted:
        return spark.createDataFrame([], out)

    per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES * parts // (8 * width)))
    blocks = -(-seen["n"] // per_block)
    q_blocks = -(-n_wanted // max(1, min(QUERY_ROWS, per_block)))
    tasks = min(4 * cpu_partitions(rows), parts * blocks)
    lists = _packed(objects, blocks, width, parts)

    def meet(queries: DataFrame, kernel) -> DataFrame:
        packed = _packed(queries, q_blocks, width, parts)
        sent = packed.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("nodes").alias("q_nodes"),
                             F.col("tau").alias("q_tau"), F.col("tau_first").alias("q_tau_first"), F.col("m").alias("q_m"))
        both = lists.repartition(tasks, "part", "block").join(sent.repartition(tasks, "part", "block"), ["part", "block"])
        return both.select("part", "nodes", "firsts", "m", "q_nodes", "q_tau", "q_tau_first", "q_m").mapInArrow(kernel, _LISTED)

    best = [F.col("score").desc(), F.col("first"), F.col("node")]
    listed = _top(meet(wanted, _best(keep)), ["q", "part"], [F.col("partial").desc(), F.col("first"), F.col("node")], keep)
    known = _exact(listed.select("q", "node", "first").distinct(), objects)
    cutoff = _top(known, ["q"], best, keep).groupBy("q").agg(
        F.max(F.when(F.col("rn") == keep, F.struct("score", "first"))).alias("at"))
    # with fewer objects than that, all of them are wanted
    cutoff = cut_lineage(cutoff.select("q", F.coalesce("at.score", F.lit(-LAST - 1)).alias("tau"), F.coalesce("at.first", F.lit(LAST)).alias("tau_first")))

    told = wanted.join(cutoff.withColumnRenamed("q", "node"), "node")
    entries = meet(told, _reaching(parts)).groupBy("q", "node", "first").agg(
        F.sum("partial").alias("known"), F.count(F.lit(1)).alias("in_lists"))
    tau = F.col("tau").cast("decimal(38,0)")
    able = cut_lineage(entries.join(cutoff, "q").where(
        parts * F.col("known") + (parts - F.col("in_lists")) * tau >= parts * tau).select("q", "node", "first", "known", "in_lists"))
    whole = able.where(F.col("in_lists") == parts).select("q", "node", "first", F.least(F.greatest(
        "known", F.lit(-LAST - 1).cast("decimal(38,0)")), F.lit(LAST).cast("decimal(38,0)")).cast("long").alias("score"))
    scored = whole.unionByName(_exact(able.where(F.col("in_lists") < parts), objects))

    short = _top(scored, ["q"], best, keep).join(objects.select("node", "ids"), "node") \
        .select("q", "score", (F.col("node") == F.col("q")).alias("same"), F.explode("ids").alias("by"))
    few = _top(short, ["q"], [F.col("score").desc(), F.col("by")], keep).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), "score", "same", F.col("by.id").alias("id"))), asc=False).alias("l"))
    found = asked.join(few, "q")
    own = F.array_position(F.transform("l", lambda x: x["same"] & x["id"].eqNullSafe(F.col("query_id"))), F.lit(True))
    l = F.when(F.col("own") > 0, F.concat(F.slice("l", F.lit(1), F.col("own") - 1), F.slice("l", F.col("own") + 1, F.lit(keep)))).otherwise(F.col("l"))
    found = found.withColumn("own", own.cast("int")).select("query_id", F.posexplode(F.slice(l, 1, k)).alias("rank", "x"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
