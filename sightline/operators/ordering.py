"""Order-dependent helpers that stay distributed.

All of them range-partition the rows on the order once and write that frame, with each row's partition and place, to
the shared checkpoint folder.  Per-partition totals and the rows themselves are both read from the stored table, so
they cannot disagree (a second shuffle would sample its own bounds, and adaptive execution may coalesce it otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _ranged(df: DataFrame, key: Column) -> DataFrame:
    """``df`` in ranges of ``key``, stored: ``_od_pid`` orders the ranges, ``_od_li`` the rows of a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    r = df.withColumn("_od_k", key).repartitionByRange(parts, "_od_k").sortWithinPartitions("_od_k")
    return cut_lineage(r.withColumn("_od_pid", F.spark_partition_id()).withColumn("_od_li", F.monotonically_increasing_id()))


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Add ``name`` = position of each row in ``order`` (ascending value expressions
    forming a total order; negate a numeric key for descending), from ``start``."""
    ranged = _ranged(df, F.struct(*order))
    sizes = ranged.groupBy("_od_pid").agg(F.count(F.lit(1)).alias("_od_cnt"), F.min("_od_li").alias("_od_first"))
    # one row per partition: the unpartitioned window is bounded by the partition count
    offsets = sizes.withColumn(
        "_od_off", F.coalesce(F.sum("_od_cnt").over(Window.orderBy("_od_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).drop("_od_cnt")
    out = ranged.join(F.broadcast(offsets), "_od_pid")
    return out.withColumn(name, (F.col("_od_off") + F.col("_od_li") - F.col("_od_first") + start).cast("long")) \
        .drop("_od_k", "_od_pid", "_od_li", "_od_off", "_od_first")


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """``name`` = 1-based position of each row inside its group ``keys`` in ``order``.

    Skew-safe: rows are range-partitioned on (keys, order), so a hot group is spread
    over many tasks; each task numbers its rows, and a group's count in earlier
    partitions (one row per (partition, group)) is added.  No task ever holds a
    whole group.  ``order`` must be a total order inside a group; a null key is a group."""
    r = _ranged(df, F.struct(*[F.col(c) for c in keys], *order))
    stats = r.groupBy("_od_pid", *keys).agg(F.min("_od_li").alias("_od_first"), F.count(F.lit(1)).alias("_od_cnt"))
    stats = stats.withColumn("_od_before", F.coalesce(
        F.sum("_od_cnt").over(Window.partitionBy(*keys).orderBy("_od_pid")
                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stats = stats.select(F.col("_od_pid").alias("_od_p"), *[F.col(k).alias(f"_od_k{i}") for i, k in enumerate(keys)], "_od_first", "_od_before")
    on = F.col("_od_pid") == F.col("_od_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_od_k{i}"))
    out = r.join(stats, on)
    return out.withColumn(name, (F.col("_od_li") - F.col("_od_first") + F.col("_od_before") + 1).cast("long")) \
        .drop("_od_k", "_od_pid", "_od_li", "_od_first", "_od_before", "_od_p", *[f"_od_k{i}" for i in range(len(keys))])


def running_sum_max(df: DataFrame, order: list[Column], x: str, sum_name: str = "S",
                    max_name: str = "M") -> DataFrame:
    """Inclusive running sum ``S`` of ``x``, ``M = max(0, running max of S)`` and
    ``M_excl`` (the same over the rows before) in a total ``order``, computed in two levels (per range partition, then over one row
    per partition), so no single task sees the whole table."""
    r = _ranged(df, F.struct(*order))
    w = Window.partitionBy("_od_pid").orderBy("_od_li").rowsBetween(Window.unboundedPreceding, 0)
    w_ex = Window.partitionBy("_od_pid").orderBy("_od_li").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_od_ls", F.sum(x).over(w)).withColumn("_od_lm", F.max("_od_ls").over(w)) \
        .withColumn("_od_lme", F.max("_od_ls").over(w_ex))
    parts = r.groupBy("_od_pid").agg(F.sum(x).alias("_od_pt"), F.max("_od_ls").alias("_od_pm"))
    before = Window.orderBy("_od_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("_od_off", F.coalesce(F.sum("_od_pt").over(before), F.lit(0)))
             .withColumn("_od_pmax", F.coalesce(F.max(F.col("_od_off") + F.col("_od_pm")).over(before), F.lit(0))))
    out = r.join(F.broadcast(parts.select("_od_pid", "_od_off", "_od_pmax")), "_od_pid")  # one row per partition
    out = out.withColumn(sum_name, F.col("_od_off") + F.col("_od_ls")) \
        .withColumn(max_name, F.greatest(F.lit(0), F.col("_od_pmax"), F.col("_od_off") + F.col("_od_lm"))) \
        .withColumn(max_name + "_excl", F.greatest(F.lit(0), F.col("_od_pmax"), F.col("_od_off") + F.col("_od_lme")))
    return out.drop("_od_k", "_od_pid", "_od_li", "_od_ls", "_od_lm", "_od_lme", "_od_off", "_od_pmax")


def first_per_key(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Rows that are the first (smallest ``seq``) of their ``keys``.

    ``groupBy().min`` aggregates partially before the shuffle, so a hot key costs one
    row per task; the semi join back is on (keys, seq), which is unique and so not
    skewed."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*seq)).alias("_m")) \
        .select(*keys, *[F.col("_m." + s).alias(s) for s in seq])
    return df.join(firsts, [*keys, *seq], "left_semi")


def cpu_partitions(df: DataFrame) -> int:
    """Partition count for CPU-heavy stages after a shuffle: the session's shuffle
    partitions, at least the cluster's parallelism (AQE would otherwise coalesce
    small-but-expensive shuffles into a single task)."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def posexplode_rows(df: DataFrame, cols: list, arr: Column, pos: str, val: str) -> DataFrame:
    """``posexplode`` of a computed array without Catalyst's inferred ``size(arr) > 0``
    filter (which would evaluate the array expression a second time, below any
    shuffle): the outer form, then drop the empty-array row by its null position."""
    return df.select(*cols, F.posexplode_outer(arr).alias(pos, val)).where(F.col(pos).isNotNull())


def explode_rows(df: DataFrame, cols: list, arr: Column, val: str) -> DataFrame:
    """``explode`` of a computed array, see ``posexplode_rows``."""
    return posexplode_rows(df, cols, arr, "_pos", val).drop("_pos")
