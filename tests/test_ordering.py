"""Numbering helpers against plain windows, on inputs that outgrow the range sampler."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import ordering as od

N = 300_000


def _rows(spark):
    # one key holds a third of all rows, one key is null; a wide payload
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") % 977).cast("string"))
    return spark.range(N).select("id", key.alias("key"), F.xxhash64("id").alias("h"), F.repeat(F.lit("payload "), 6).alias("wide"),
                                 (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(21)) - 10).alias("x"))


@pytest.mark.parametrize("parts,adaptive", [(1, True), (4, True), (64, True), (64, False)])
def test_numbers_equal_windows(spark, parts, adaptive):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    try:
        df = _rows(spark).repartition(max(2, parts))
        got = od.dense_index(df, [F.col("h"), F.col("id")], "n")
        got = od.rank_in_group(got, ["key"], [F.col("h"), F.col("id")], "rn")
        got = od.running_sum_max(got, [F.col("h"), F.col("id")], "x", "S", "M")
        order = Window.orderBy("h", "id")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        want = _rows(spark).select(
            "id", (F.row_number().over(order) - 1).alias("n"), F.row_number().over(Window.partitionBy("key").orderBy("h", "id")).alias("rn"),
            F.sum("x").over(upto).alias("S"))
        want = want.withColumn("M", F.greatest(F.lit(0), F.max("S").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))))
        assert got.count() == N
        both = got.select("id", "n", "rn", "S", "M").join(want.selectExpr("id", "n n2", "rn rn2", "S S2", "M M2"), "id")
        assert both.where("n = n2 AND rn = rn2 AND S = S2 AND M = M2").count() == N
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_empty(spark):
    df = spark.createDataFrame([], "id long, key string, x long")
    assert od.dense_index(df, [F.col("id")]).count() == 0
    assert od.rank_in_group(df, ["key"], [F.col("id")]).count() == 0
    assert od.running_sum_max(df, [F.col("id")], "x").count() == 0
