"""Joins on hot keys, digests of hot lines and scoring of hot tokens: results and how rows are dealt."""

import random

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import learn as ln
from sightline.operators import recommend as rc
from sightline.operators.skew import heavy_keys, salted_join


def test_salted_join(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice([None, f"k{rnd.randrange(400)}"])) for i in range(12_000)]
    left = spark.createDataFrame(rows, "id long, k string").repartition(6)
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 400, 2)]], "name string, v int")
    values = dict(right.collect())
    want = sorted((i, k, values.get(k)) for i, k in rows if k is not None)
    got = salted_join(left, right, "k", "name")
    assert got.columns == ["id", "k", "name", "v"]
    assert sorted((r["id"], r["k"], r["v"]) for r in got.collect() if r["k"] is not None) == want and got.count() == len(rows)
    assert salted_join(left, right, "k", "name", "inner").count() == sum(v is not None for _, _, v in want)
    hot = heavy_keys(left, "k", 8).collect()
    assert spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0] in {r["h"] for r in hot} and len(hot) <= 32
    assert salted_join(left.limit(0), right, "k", "name").count() == 0


def test_salted_join_deals_a_hot_key_out(spark):
    """With a key that holds a third of all rows the largest task reads less than three times the median."""
    left = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = left.select(F.col("k").alias("name")).distinct().withColumn("v", F.length("name"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "16", "-1")):
            spark.conf.set(c, v)
        plain = left.join(right, left["k"] == right["name"]).groupBy(F.spark_partition_id()).count().collect()
        dealt = salted_join(left, right, "k", "name").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    worst = lambda rows: max(r["count"] for r in rows) / np.median([r["count"] for r in rows])
    assert worst(plain) > 4 and worst(dealt) < 3


def test_digest_of_a_hot_line_in_slices(spark, monkeypatch):
    """A line with a third of the comments: pieces of a few comments, in order over all lines that are similar."""
    monkeypatch.setattr(rc, "SLICE", 16)
    rnd = random.Random(1)
    comments = [(i, "hot" if i % 3 == 0 else f"l{rnd.randrange(20)}", None if i % 17 == 0 else f"m{i}", rnd.choice(["a", "b"]), float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(comments, "seq long, line string, message string, purpose string, s double").repartition(5)
    sim = [(q, s) for q in ("q1", "q2", "q3") for s in ["hot", "l1", "l2", "none"][:int(q[1]) + 1]] + [("q4", "none")]
    similar = spark.createDataFrame(sim + sim[:2], "query_line string, similar_line string")
    texts = rc.comments_by_text(df, ["a", "b"], ["s"], ["seq"], line_col="line")
    assert max(r["_n"] for r in texts.collect()) <= 16
    got = {r["query_line"]: r for r in rc.aggregate_comments(similar, df, ["a", "b"], ["s"], ["seq"], line_col="line").collect()}
    for q in ("q1", "q2", "q3", "q4"):
        on = {s for k, s in sim if k == q}
        own = [c for c in comments if c[1] in on]
        assert got[q]["no_similar_lines"] == len(on) and got[q]["no_comments"] == len(own)
        assert got[q]["messages"] == " ||| ".join(c[2] for c in own if c[2] is not None)
        assert got[q]["lines"] == " ||| ".join(c[1] for c in own)
        assert abs(got[q]["a"] - (sum(c[3] == "a" for c in own) / len(own) if own else 0)) < 1e-9
        assert got[q]["s"] == (sum(c[4] for c in own) / len(own) if own else None)


def test_scores_do_not_depend_on_the_head(spark, monkeypatch):
    """All tokens in the broadcast head, a few, or none: the same sums; a token that holds most places; null texts."""
    rnd = random.Random(2)
    docs = [(i, " ".join("the" if rnd.random() < 0.5 else f"w{rnd.randrange(60)}" for _ in range(12)), i % 2) for i in range(80)]
    train = spark.createDataFrame(docs, "id long, line string, y int")
    rows = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, "never seen"), (903, "the " * 500)], "id long, line string").repartition(3)
    model = ln.train_binary(train, "line", "y")
    cm = ln.train_comments(train.withColumn("p", F.when(F.col("y") == 0, "a").otherwise("b")).withColumn("s", F.col("y").cast("double")), "line", "p", ["a", "b", "c"], ["s"])
    told = []
    for head in (1 << 18, 5, 0):
        monkeypatch.setattr(ln, "HEAD_TOKENS", head)
        scored = {r["id"]: r["score"] for r in ln.score_binary(rows, "line", model, ["id"]).collect()}
        classed = {r["id"]: (r["pred_purpose"], r["prob_s"], r["pred_s"]) for r in ln.classify_comments(rows, "line", cm, ["a", "b", "c"], ["s"]).collect()}
        told.append((scored, classed))
    assert len(told[0][0]) == len(docs) + 4
    for scored, classed in told[1:]:
        assert all(abs(scored[i] - told[0][0][i]) < 1e-9 and abs(classed[i][1] - told[0][1][i][1]) < 1e-9 for i in scored)
        assert {i: c[0] for i, c in classed.items()} == {i: c[0] for i, c in told[0][1].items()}
    assert all(abs(told[0][0][i] - told[0][1][i][1]) < 1e-9 for i in told[0][0])  # a subject is a binary model
