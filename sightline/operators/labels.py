"""Label encodings and class weights (rows 41-43, 80-82)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def purpose_code(purpose, labels: list[str]) -> Column:
    """Row 80: label -> position in ``labels`` (unordered categories); unknown or null -> null."""
    pos = F.array_position(F.array(*[F.lit(l) for l in labels]), _c(purpose))
    return F.when(pos > 0, (pos - 1).cast("int"))


def purpose_one_hot(df: DataFrame, purpose_col: str, labels: list[str], prefix: str = "") -> DataFrame:
    """Row 80: one int column per label (all zero for an unknown label)."""
    return df.select("*", *[(F.col(purpose_col) == l).cast("int").alias(prefix + l) for l in labels]) \
        .fillna(0, subset=[prefix + l for l in labels])


def encode_subjects(df: DataFrame, subjects: list[str], single: str | None = None) -> DataFrame:
    """Row 81: subject flags of a table (all, or one), nulls -> 0.0."""
    cols = [single] if single else subjects
    return df.select(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in cols])


def decode_purpose(scores, labels: list[str]) -> Column:
    """Row 82: label of the highest score, the first one on ties."""
    s = _c(scores)
    return F.element_at(F.array(*[F.lit(l) for l in labels]), F.array_position(s, F.array_max(s)).cast("int"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Rows 41/42: balanced weights n / (classes present * n_class), nulls dropped."""
    per = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy()  # over the grouped table: one row per class
    return per.select(label_col, "n", (F.sum("n").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n")))
                      .alias("weight"))


def subject_weights(df: DataFrame, subjects: list[str]) -> DataFrame:
    """Row 43 (Q19: all three returned): per subject and class value (0/1 after
    null -> 0): ``n``, the balanced ``weight``, the subject's own weight
    ``subject_weight`` = sum of all flags / (sum of its flags * #subjects), and the
    ``product`` of the two."""
    k = len(subjects)
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("subject"),
                                                  F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias("value"))
                                         for s in subjects])).alias("x")).select("x.*")
    per = tall.groupBy("subject", "value").agg(F.count(F.lit(1)).alias("n"))
    ws = Window.partitionBy("subject")
    per = per.withColumn("weight", F.sum("n").over(ws) / (F.count(F.lit(1)).over(ws) * F.col("n")))
    flags = per.withColumn("_f", F.col("value") * F.col("n"))
    flags = flags.withColumn("_fs", F.sum("_f").over(ws)).withColumn("_fa", F.sum("_f").over(Window.partitionBy()))
    return flags.select("subject", "value", "n", "weight",
                        F.try_divide(F.col("_fa"), F.col("_fs") * k).alias("subject_weight"),
                        (F.col("weight") * F.try_divide(F.col("_fa"), F.col("_fs") * k)).alias("product"))
