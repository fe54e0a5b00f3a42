"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key; inside a source, rows are ordered by key in ranges that are a pure function of the
key (its leading bits), so ranges of a hot source are dealt to many tasks.  Running sums inside ranges plus prefix
sums over range totals give every row's place in its source's epoch; a budget is cut at the exact word, after as
many whole epochs as fit.

The key comes from doc_id, source and text, so rows of a source that share a doc_id, or have none, still spread over
the key ranges; of rows equal in all three each has a number of its own among them, mixed into the key.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last in order; rows
that repeat a doc_id are mixed as separate rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import rank_in_group
from ..session import cut_lineage
from .common import WORD, has_unique_ids

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rows in a range of keys, on average.  A plan size, not a limit: every range is read whole.
RANGE_ROWS = 2048


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (source, source_size, n_rows).  Adds ``target``: the share of all words dealt by
    weight, stopping at ``max_epochs`` times the size, the excess reshared until none is above.

    That limit is a water level: with sources in order of cap / weight, the capped ones are a prefix, and the level
    is what is left over the weights that are left.  One row per source is ordered here, in one task: sources are
    corpora with a weight each, not pages or sites."""
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_code) - 1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(ws, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), zero))
              .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), zero))
              .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left")))
    # capped while its cap is at most the level that would hold from it on
    ranked = ranked.withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level")))).over(every)["level"])
    return ranked.select("source", "source_size", "n_rows",
                         F.when(F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def own_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with a key of its own for every row: rows that share one get it mixed with their number among them, so
    a rerun deals out the same keys.  Numbers are given in ranges of rows, however many share a key."""
    shared = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if shared.isEmpty():
        return rows.drop("row_no")
    twins = rank_in_group(rows.join(shared, "key", "left_semi"), ["key"], [F.col("row_no")], "place")
    return rows.join(shared, "key", "left_anti").drop("row_no").unionByName(
        twins.withColumn("key", F.xxhash64("key", "place")).drop("row_no", "place"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted),
    ``epochs`` (whole copies) and ``cut_words`` (words of one more, cut at the budget)."""
    rows = own_keys(cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")).alias("key"),
        F.monotonically_increasing_id().alias("row_no"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = cut_lineage(source_targets(sizes, weights, share, max_epochs)
                          .withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / RANGE_ROWS))).cast("int"))
                          .withColumnRenamed("source", "of"))
    # one row per source meets every row: adaptive execution broadcasts it when it is small and splits skew when not
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # the key's leading bits, moved to be unsigned: a range of keys of about RANGE_ROWS rows of this source
    placed = placed.withColumn("rng", F.expr("shiftrightunsigned(key, 32) div shiftleft(1L, 32 - bits)"))
    order = [F.expr("shiftrightunsigned(key, 1)"), F.col("key"), F.col("doc_id"), F.col("size")]
    within = Window.partitionBy("source", "rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = cut_lineage(placed)
    totals = placed.groupBy("source", "rng").agg(F.sum("size").alias("words"))
    ranges = totals.withColumn("offset", F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.select(F.col("source").alias("of"), F.col("rng").alias("in"), "offset")
    out = placed.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("rng") == F.col("in")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", epochs)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("before"))).cast("long")
    out = out.withColumn("cut_words", cut)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("cut_words")).alias("taken"), "epochs", "cut_words")


def mixed_documents(docs: DataFrame, seed: int = 7, **weights) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each row as often as it is taken, whole.  The last copy, which the
    budget cuts, is there when at least half of its words are inside the budget; rows without words are not taken."""
    if has_unique_ids(docs):
        marked = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("row_no"))
        taken = mix(docs.select("doc_id", "source", "text"), seed, **weights)
    else:
        marked = cut_lineage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row_no")))
        taken = mix(marked.select(F.col("row_no").alias("doc_id"), "doc.source", "doc.text"), seed, **weights)
    copies = (F.col("epochs") + (F.col("cut_words") * 2 >= F.col("size")).cast("long")).cast("int")
    taken = taken.where("size > 0").select(F.col("doc_id").alias("row_no"), copies.alias("copies")).where("copies > 0")
    out = marked.join(taken, "row_no")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
