"""Evaluation metrics from confusion counts (rows 44-50, 52, 53).

Everything derives from one grouped count per (target, truth, prediction): the
metrics are SQL arithmetic over that small table.  Q1 fixed (recall is recall),
Q25 fixed (rows with a null truth are dropped and counted), Q31 fixed (full
label grid with zero cells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, truth: str, pred: str, labels: list | None = None,
                     target: str | None = None) -> DataFrame:
    """Row 44: ``[target,] t, p, n, share`` with every (t, p) label pair, share within t
    (null when t has no rows).  ``labels`` defaults to the values seen."""
    keys = [target] if target else []
    d = df.where(F.col(truth).isNotNull()).select(*keys, F.col(truth).alias("t"), F.col(pred).alias("p"))
    counts = d.groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    # label set per target: the classes seen (or the given list); the output grid is
    # labels x labels per target, so its size is the size of the result itself
    if labels is None:
        seen = d.select(*keys, F.col("t").alias("l")).union(d.select(*keys, F.col("p").alias("l")))
        labs = seen.groupBy(*keys).agg(F.array_sort(F.collect_set("l")).alias("ls"))
    else:
        lit = F.array(*[F.lit(l).cast(d.schema["t"].dataType) for l in labels])
        base = d.select(*keys).distinct() if keys else df.sparkSession.range(1)
        labs = base.select(*keys, lit.alias("ls"))
    grid = labs.select(*keys, F.explode("ls").alias("t"), "ls").select(*keys, "t", F.explode("ls").alias("p"))
    out = grid.join(counts, [*keys, "t", "p"], "left").fillna(0, subset=["n"])
    w = Window.partitionBy(*keys, "t")
    return out.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(w).cast("double")))


def _scores(cm: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro precision / recall / F1 and MCC from confusion counts."""
    per_t = cm.groupBy(*keys, F.col("t").alias("l")).agg(F.sum("n").alias("tc"))
    per_p = cm.groupBy(*keys, F.col("p").alias("l")).agg(F.sum("n").alias("pc"))
    diag = cm.where(F.col("t") == F.col("p")).select(*keys, F.col("t").alias("l"), F.col("n").alias("tp"))
    per = per_t.join(per_p, [*keys, "l"], "full").join(diag, [*keys, "l"], "left").fillna(0, subset=["tc", "pc", "tp"])
    per = per.where((F.col("tc") > 0) | (F.col("pc") > 0))  # labels present in truth or prediction
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pc").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tc").cast("double")), F.lit(0.0))
    per = per.withColumn("_p", prec).withColumn("_r", rec)
    per = per.withColumn("_f", F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")),
                                          F.lit(0.0)))
    agg = per.groupBy(*keys).agg(
        F.sum("tp").cast("double").alias("c"), F.sum("tc").cast("double").alias("s"),
        F.sum(F.col("pc").cast("double") * F.col("tc").cast("double")).alias("pt"),
        F.sum(F.col("pc").cast("double") * F.col("pc").cast("double")).alias("pp"),
        F.sum(F.col("tc").cast("double") * F.col("tc").cast("double")).alias("tt"),
        F.avg("_p").alias("precision"), F.avg("_r").alias("recall"), F.avg("_f").alias("f1"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((F.col("c") * F.col("s") - F.col("pt")) / den)
    return agg.select(*keys, F.try_divide(F.col("c"), F.col("s")).alias("accuracy"), "precision", "recall", "f1",
                      mcc.alias("mcc"))


def binary_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Row 46: one row ``accuracy, precision, recall, f1, mcc`` (macro averages)."""
    return _scores(confusion_counts(df, truth, pred), [])


def multilabel_confusion(df: DataFrame, truth_cols: list[str], pred_cols: list[str]) -> DataFrame:
    """Row 45: 2x2 confusion per subject (truth/prediction nulls -> 0), with row shares."""
    tall = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("subject"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).cast("int").alias("t"),
                 F.coalesce(F.col(p).cast("double"), F.lit(0.0)).cast("int").alias("p"))
        for t, p in zip(truth_cols, pred_cols)])).alias("x")).select("x.*")
    return confusion_counts(tall, "t", "p", labels=[0, 1], target="subject")


def comment_report(df: DataFrame, purpose_truth: str, purpose_pred: str, subject_truth: list[str],
                   subject_pred: list[str]) -> DataFrame:
    """Row 47: tall report, one row per target (``purpose`` and each subject)."""
    rows = [F.struct(F.lit("purpose").alias("target"), F.col(purpose_truth).alias("t"),
                     F.col(purpose_pred).alias("p"))]
    rows += [F.struct(F.lit(t).alias("target"),
                      F.coalesce(F.col(t).cast("double"), F.lit(0.0)).cast("int").cast("string").alias("t"),
                      F.coalesce(F.col(p).cast("double"), F.lit(0.0)).cast("int").cast("string").alias("p"))
             for t, p in zip(subject_truth, subject_pred)]
    tall = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return _scores(confusion_counts(tall, "t", "p", target="target"), ["target"])


def comment_report_wide(report: DataFrame, subjects: list[str], name: str | None = None) -> DataFrame:
    """Row 48: one row ``name, p_acc, p_prec, p_rec, p_f1, p_mcc, s_<subject>_acc, ...``."""
    metrics = [("accuracy", "acc"), ("precision", "prec"), ("recall", "rec"), ("f1", "f1"), ("mcc", "mcc")]
    cols = [F.lit(name).cast("string").alias("name")]
    for m, short in metrics:
        cols.append(F.max(F.when(F.col("target") == "purpose", F.col(m))).alias(f"p_{short}"))
    for s in subjects:
        for m, short in metrics:
            cols.append(F.max(F.when(F.col("target") == s, F.col(m))).alias(f"s_{s}_{short}"))
    return report.agg(*cols[1:]).select(cols[0], *[f"p_{sh}" for _, sh in metrics],
                                        *[f"s_{s}_{sh}" for s in subjects for _, sh in metrics])


def length_percentiles(df: DataFrame, length_col: str, percents=(90, 95, 98, 99, 100)) -> DataFrame:
    """Row 49: exact percentiles with linear interpolation, one column per percent."""
    return df.agg(*[F.percentile(length_col, F.lit(p / 100.0)).alias(f"p{p}") for p in percents])


def percentile_of_score(df: DataFrame, length_col: str, score: float) -> DataFrame:
    """Row 50: percentile rank of ``score`` with ties averaged (kind='rank')."""
    c = F.col(length_col)
    lt = F.count_if(c < score)
    le = F.count_if(c <= score)
    return df.agg(((lt + le + F.when(le > lt, 1).otherwise(0)).cast("double") * (50.0 / F.count(c)))
                  .alias("percentile"))


def corpus_counts(lines: DataFrame, file_col: str = "filename") -> DataFrame:
    """Row 52: ``filename, n_lines`` per file."""
    return lines.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_lines"))


def corpus_totals(lines: DataFrame, file_col: str = "filename") -> DataFrame:
    """Row 52: number of files and of lines."""
    return lines.agg(F.count_distinct(file_col).alias("n_files"), F.count(F.lit(1)).alias("n_lines"))


def steps_per_epoch(pairs: DataFrame, batch_size: int) -> DataFrame:
    """Row 53: floor(pairs / batch size)."""
    return pairs.agg(F.floor(F.count(F.lit(1)) / batch_size).cast("long").alias("steps_per_epoch"))
