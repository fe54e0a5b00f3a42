"""Training-set preparation (rows 14-25, 37-40, 54-58, 66, 67, 90).

The reference walks changes one by one with global sets and counters.  Here
every step is a set operation keyed by change or by line text, and the only
cross-change state (the carried OK-line quota) becomes prefix sums over one row
per change, or a scan of functions where the ratio is above 1.  Sequence columns (``seq``) carry the input order explicitly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordering import _ranged, dense_index, first_per_key, rank_in_group, running_sum_max

DEFAULT_COLUMNS_TO_PRESERVE = ["change_id", "revision_id", "filename", "line_contents"]


# --- rows 14-20: projections and filters ----------------------------------

def project_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row 14: keep the named columns, in the given order."""
    return df.select(*cols)


def fill_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row 15: null text -> ''."""
    return df.fillna("", subset=cols)


def fill_subjects(df: DataFrame, subjects: list[str]) -> DataFrame:
    """Row 16: null subject flag -> 0.0."""
    return df.fillna(0.0, subset=subjects)


def drop_empty_lines(df: DataFrame, line_col: str = "line_contents") -> DataFrame:
    """Row 17: drop exactly-empty (and null) lines; whitespace-only lines stay."""
    return df.where(F.col(line_col) != "")


def filter_purposes(df: DataFrame, labels: list[str], purpose_col: str = "purpose") -> DataFrame:
    """Row 18: keep comments whose purpose is listed; null purposes drop."""
    return df.where(F.col(purpose_col).isin(list(labels)))


def filter_dates(df: DataFrame, ts_col: str, from_date=None, to_date=None, inclusive: bool = False) -> DataFrame:
    """Row 19 (Q5 kept): strictly between the bounds unless ``inclusive``; each bound optional."""
    c = F.col(ts_col)
    cond = F.lit(True)
    if from_date is not None:
        cond = cond & ((c >= F.lit(from_date).cast("timestamp")) if inclusive else (c > F.lit(from_date).cast("timestamp")))
    if to_date is not None:
        cond = cond & ((c <= F.lit(to_date).cast("timestamp")) if inclusive else (c < F.lit(to_date).cast("timestamp")))
    return df.where(cond)


SUFFIX_PATTERN = r"(\.[^./]+)$"


def file_suffix(path_col):
    return F.regexp_extract(F.col(path_col) if isinstance(path_col, str) else path_col, SUFFIX_PATTERN, 1)


def filter_files(df: DataFrame, path_col: str, extensions: list[str] | None = None,
                 exclude_substring: str | None = "COMMIT") -> DataFrame:
    """Row 20 (Q8 kept): suffix in ``extensions``; name does not contain ``exclude_substring``."""
    cond = F.lit(True)
    if extensions is not None:
        cond = cond & file_suffix(path_col).isin(list(extensions))
    if exclude_substring:
        cond = cond & ~F.col(path_col).contains(exclude_substring)
    return df.where(cond)


def limit_files(df: DataFrame, path_col: str, n: int) -> DataFrame:
    """Row 22: rows of the first ``n`` files in listing (path) order."""
    files = df.select(path_col).distinct().orderBy(path_col).limit(n)
    return df.join(files, path_col, "left_semi")


# --- rows 23-25: joins by change ------------------------------------------

def lines_in_reviewed_changes(lines: DataFrame, commented: DataFrame, change_col: str = "change_id") -> DataFrame:
    """Row 23: lines from changes that have at least one commented line."""
    return lines.join(commented.select(change_col).distinct(), change_col, "left_semi")


def ok_lines(lines: DataFrame, commented: DataFrame, change_col: str = "change_id",
             line_col: str = "line_contents") -> DataFrame:
    """Row 24 (Q9 fixed): lines whose text nobody commented on in the same change."""
    return lines.join(commented.select(change_col, line_col).distinct(), [change_col, line_col], "left_anti")


def change_cogroup(lines: DataFrame, commented: DataFrame, change_col: str = "change_id") -> DataFrame:
    """Row 25: both tables matched by change: per-change counts of each side."""
    c = commented.groupBy(change_col).agg(F.count(F.lit(1)).alias("n_commented"))
    n = lines.groupBy(change_col).agg(F.count(F.lit(1)).alias("n_lines"))
    return c.join(n, change_col, "full").fillna(0, subset=["n_commented", "n_lines"])


# --- rows 54-58: ordered per-change steps ----------------------------------

def cap_commented(commented: DataFrame, lines: DataFrame, seq: list[str], change_col: str = "change_id") -> DataFrame:
    """Row 55: keep the first m commented lines of a change, m = its number of lines."""
    m = lines.groupBy(change_col).agg(F.count(F.lit(1)).alias("_m"))
    ranked = rank_in_group(commented, [change_col], [F.col(s) for s in seq], "_rn")
    return ranked.join(m, change_col, "left").where(F.col("_rn") <= F.coalesce("_m", F.lit(0))).drop("_rn", "_m")


def dedup_commented(commented: DataFrame, seq: list[str], change_col: str = "change_id",
                    line_col: str = "line_contents") -> DataFrame:
    """Row 54: first of equal commented lines in a change."""
    return first_per_key(commented, [change_col, line_col], seq)


def change_order(commented: DataFrame, seq: list[str], change_col: str = "change_id") -> DataFrame:
    """Changes in order of first appearance among the commented lines: ``change_col, change_rank``."""
    firsts = commented.groupBy(change_col).agg(F.min(F.struct(*seq)).alias("_first"))
    return dense_index(firsts, [F.col("_first")], "change_rank").drop("_first")


def quota_take(counts: DataFrame, ratio: float, carry: bool) -> DataFrame:
    """Rows 56/57: number of OK lines ``t`` each change gives.

    ``counts`` has one row per change: ``change_rank, c`` (commented kept) and ``a``
    (eligible OK lines).  Without carry ``t = min(a, ceil(c*ratio))``.  With carry
    (Q11 kept) a change keeps giving while the running OK total is below the running
    commented total: ``t_i = min(a_i, max(r_i, c_i - D_{i-1}))`` with D = T - C.  For
    ratio <= 1, D_i = min(D_{i-1} + a_i - c_i, 0), so D = S - max(0, running max S)
    with S the prefix sum of (a - c): two-level prefix sums, no sequential loop.
    """
    r = F.ceil(F.col("c") * F.lit(float(ratio))).cast("long")
    base = counts.withColumn("r", r)
    if not carry:
        return base.withColumn("t", F.least(F.col("a"), F.col("r")))
    if ratio <= 1:
        x = base.withColumn("_x", (F.col("a") - F.col("c")).cast("long"))
        s = running_sum_max(x, [F.col("change_rank")], "_x", "_S", "_M")
        d_prev = F.col("_S") - F.col("_x") - F.col("_M_excl")
        return s.withColumn("t", F.least(F.col("a"), F.col("c") - d_prev)).drop("_x", "_S", "_M", "_M_excl")
    return _fold_carry(base)


#: Changes whose effect on the surplus is one function.
CARRY_CHUNK = 4096


def carried(x, y, shift: int, d: int) -> int:
    """Value at ``d`` of a function given by its corners (slope 1 outside of them, 0 or 1 between)."""
    if not len(x):
        return d + shift
    i = int(np.searchsorted(x, d, "right"))
    if i == 0:
        return int(y[0]) - (int(x[0]) - d)
    return min(int(y[i - 1]) + (d - int(x[i - 1])), int(y[i]) if i < len(x) else int(y[i - 1]) + (d - int(x[i - 1])))


def carry_function(c, a, r):
    """The effect of a run of changes on the surplus D, as corners.  One change makes D to
    ``min(D + (a - c), max(0, D + min(a, r) - c))``: slope 1, flat at 0, slope 1.  Runs of them have more flats, at most
    one for each change; all corners between two of which nothing bends are left out."""
    x, y, shift = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for ci, ai, ri in zip(c, a, r):
        high, low = ai - ci, min(ai, ri) - ci
        if high == low:
            y, shift = y + high, shift + high
            continue
        # where the run so far reaches the flat's ends: corners of their own, those in between go
        if len(x):
            left = _reach(x, y, -high, False)
            right = _reach(x, y, -low, True)
            below, above = y < -high, y > -low
            x = np.concatenate([x[below], [left, right], x[above]])
            y = np.concatenate([y[below] + high, [0, 0], y[above] + low])
        else:
            x, y = np.array([-high - shift, -low - shift]), np.zeros(2, np.int64)
    return x, y, shift


def _reach(x, y, level: int, last: bool) -> int:
    """The first (or last) point at which a function given by corners has the value ``level``."""
    if level < y[0]:
        return int(x[0] - (y[0] - level))
    if level > y[-1]:
        return int(x[-1] + (level - y[-1]))
    if last:
        i = int(np.searchsorted(y, level, "right")) - 1  # the last corner at or below the level
        return int(x[i] + (level - y[i]))
    i = int(np.searchsorted(y, level, "left"))  # the first corner at or above the level
    return int(x[i] - (y[i] - level))


def _carry_functions(t: pa.Table) -> pa.Table:
    t = t.sort_by("change_rank")
    x, y, shift = carry_function(*(t.column(n).to_pylist() for n in ("c", "a", "r")))
    return pa.table({"_od_pid": t.column("_od_pid")[:1], "_chunk": t.column("_chunk")[:1], "x": pa.array([x.tobytes()], pa.binary()),
                     "y": pa.array([y.tobytes()], pa.binary()), "shift": pa.array([shift], pa.int64())})


def _carry_starts(batches):
    d = 0
    for b in batches:
        starts = []
        for x, y, shift in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            starts.append(d)
            d = carried(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), shift, d)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64())], ["_od_pid", "_chunk", "_d"])


def _carry_replay(t: pa.Table) -> pa.Table:
    t = t.sort_by("change_rank")
    d, out = t.column("_d")[0].as_py(), []
    for c, a, r in zip(*(t.column(n).to_pylist() for n in ("c", "a", "r"))):
        out.append(min(a, max(r, c - d)))
        d += out[-1] - c
    return t.drop_columns(["_d"]).append_column("t", pa.array(out, pa.int64()))


def _fold_carry(base: DataFrame) -> DataFrame:
    """Carry with ratio > 1 as a scan of functions: changes lie in stored ranges of their order, cut into chunks; each
    chunk's effect on the surplus is composed into one piecewise linear function, the surplus at every chunk's start
    follows from these alone (one row per chunk), and the chunks are replayed side by side."""
    base = base.withColumns({n: F.col(n).cast("long") for n in ("c", "a", "r")})
    rows = _ranged(base, F.col("change_rank"))
    # the row's place in its stored range, in the lower bits of the id
    rows = rows.withColumn("_chunk", F.floor(F.col("_od_li") % F.lit(1 << 33) / CARRY_CHUNK).cast("long")).drop("_od_k", "_od_li")
    functions = rows.select("_od_pid", "_chunk", "change_rank", "c", "a", "r").groupBy("_od_pid", "_chunk") \
        .applyInArrow(_carry_functions, "_od_pid int, _chunk long, x binary, y binary, shift long")
    starts = functions.repartition(1).sortWithinPartitions("_od_pid", "_chunk").mapInArrow(_carry_starts, "_od_pid int, _chunk long, _d long")
    out = T.StructType([*rows.schema.fields, T.StructField("t", T.LongType())])
    met = rows.join(starts, ["_od_pid", "_chunk"]).select(*rows.columns, "_d")
    return met.groupBy("_od_pid", "_chunk").applyInArrow(_carry_replay, out).drop("_od_pid", "_chunk")


def prepare_dataset(commented: DataFrame, lines: DataFrame, seq: list[str],
                    columns_to_preserve: list[str] = DEFAULT_COLUMNS_TO_PRESERVE,
                    ok_to_commented_ratio: float = 1.0,
                    balance_commented_lines_for_change: bool = True,
                    allow_taking_more_non_commented_lines_from_change: bool = True,
                    force_uniqueness_for_class: int | None = None,
                    change_col: str = "change_id", line_col: str = "line_contents",
                    exclude_commented: bool = True) -> DataFrame:
    """Row 90: labelled, balanced training set (``columns_to_preserve + [commented]``).

    Steps: fill (15), drop empty (17), lines of reviewed changes (23), cap (55),
    dedup (54), eligible OK lines (24, Q9 fixed), quota (56/57), uniqueness (58, Q10
    fixed: ambiguous texts go to the preferred class, order-free), union (66).
    Shuffles are keyed by change or by (text, seq).
    """
    # each table feeds several steps: stored once
    cm = cut_lineage(drop_empty_lines(fill_text(commented, [line_col, change_col]), line_col))
    ln = drop_empty_lines(fill_text(lines, [line_col, change_col]), line_col)
    ln = cut_lineage(lines_in_reviewed_changes(ln, cm, change_col))
    order = change_order(cm, seq, change_col)

    kept = cap_commented(cm, ln, seq, change_col) if balance_commented_lines_for_change else cm
    kept = dedup_commented(kept, seq, change_col, line_col)
    eligible = ok_lines(ln, cm, change_col, line_col) if exclude_commented else ln

    if force_uniqueness_for_class is not None:
        both = kept.select(line_col).distinct().join(eligible.select(line_col).distinct(), line_col)
        if force_uniqueness_for_class == 1:
            eligible = eligible.join(both, line_col, "left_anti")
        else:
            kept = kept.join(both, line_col, "left_anti")
        kept = first_per_key(kept, [line_col], seq)
        eligible = first_per_key(eligible, [line_col], seq)
    kept, eligible = cut_lineage(kept), cut_lineage(eligible)

    c = kept.groupBy(change_col).agg(F.count(F.lit(1)).alias("c"))
    a = eligible.groupBy(change_col).agg(F.count(F.lit(1)).alias("a"))
    counts = order.join(c, change_col, "left").join(a, change_col, "left").fillna(0, subset=["c", "a"])
    take = quota_take(counts, ok_to_commented_ratio, allow_taking_more_non_commented_lines_from_change)

    ranked = rank_in_group(eligible, [change_col], [F.col(s) for s in seq], "_rn")
    chosen = ranked.join(take.select(change_col, "t"), change_col).where(F.col("_rn") <= F.col("t"))
    pos = kept.select(*columns_to_preserve, F.lit(1).alias("commented"))
    neg = chosen.select(*columns_to_preserve, F.lit(0).alias("commented"))
    return pos.unionByName(neg)


# --- rows 37-40, 66, 67: summaries and set operations ------------------------

def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """Row 37: rows per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(df: DataFrame, line_col: str = "line_contents", label_col: str = "commented") -> DataFrame:
    """Row 38: total rows, distinct texts, rows per class (0 and 1)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(line_col).alias("n_distinct_lines"),
                  F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)).cast("long").alias("n_class_0"),
                  F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("n_class_1"))


def ambiguous_lines(df: DataFrame, line_col: str = "line_contents", label_col: str = "commented") -> DataFrame:
    """Row 39: number of texts in more than one class, and the share of all rows they make up."""
    per = df.groupBy(line_col).agg(F.count_distinct(label_col).alias("k"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("long").alias("n_ambiguous"),
                   F.try_divide(F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).cast("double"),
                                F.sum("n").cast("double")).alias("share_ambiguous"))


def distinct_lines(df: DataFrame, seq: list[str], line_col: str = "line_contents") -> DataFrame:
    """Row 40: distinct texts with their first-seen position (order key)."""
    return df.groupBy(line_col).agg(F.min(F.struct(*seq)).alias("_first")) \
        .select(line_col, *[F.col("_first." + s).alias("first_" + s) for s in seq])


def union_inputs(*dfs: DataFrame) -> DataFrame:
    """Row 66: stack tables by column name (UNION ALL)."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def lines_in_both_classes(df: DataFrame, line_col: str = "line_contents", label_col: str = "commented") -> DataFrame:
    """Row 67: texts present in class 0 and in class 1 (INTERSECT)."""
    return df.where(F.col(label_col) == 0).select(line_col).intersect(
        df.where(F.col(label_col) == 1).select(line_col))
