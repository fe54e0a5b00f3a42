"""Rows 44-50 on hand-made rows, and the driver contract."""

import math

from sightline.operators import metrics as mt


def test_binary_report_and_grid(spark):
    rows = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (0, 0)]
    df = spark.createDataFrame(rows, "t int, p int")
    r = mt.binary_report(df, "t", "p").first()
    assert abs(r["accuracy"] - 4 / 6) < 1e-12
    tp, fn, fp, tn = 2, 1, 1, 2
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert abs(r["mcc"] - mcc) < 1e-12
    assert abs(r["recall"] - (2 / 3 + 2 / 3) / 2) < 1e-12  # Q1 fixed: real recall


def test_confusion_full_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    cm = {(r["t"], r["p"]): (r["n"], r["share"]) for r in mt.confusion_counts(df, "t", "p", labels=["a", "b", "c"]).collect()}
    assert len(cm) == 9 and cm[("c", "c")] == (0, None) and cm[("a", "b")] == (1, 0.5)


def test_constant_predictions_mcc_zero(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "t int, p int")
    assert mt.binary_report(df, "t", "p").first()["mcc"] == 0.0


def test_percentile_of_score(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 3, 4]], "n int")
    # scipy kind='rank': (2 + 4 + 1) * 50 / 5 = 70
    assert mt.percentile_of_score(df, "n", 3).first()[0] == 70.0


def test_entry_contract(spark):
    import __spark_entry__ as e
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    df = e.entry(spark)
    assert "decision" in df.columns and df.count() > 0
