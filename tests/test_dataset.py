"""Rows 54-58, 90: balancing against a plain sequential statement of the rule."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from sightline.operators import dataset as ds


def seq_take(rows, ratio, carry):
    """Reference loop over changes: rows = [(c, a)], returns t per change."""
    tc = to = 0
    out = []
    for c, a in rows:
        tc += c
        m = c * ratio
        t = 0
        while t < a:
            if carry:
                if t >= m and to - tc >= 0:
                    break
            elif t >= m:
                break
            t += 1
            to += 1
        out.append(t)
    return out


def test_quota_closed_form(spark):
    rnd = random.Random(7)
    for ratio in (0.5, 1.0, 2.0):
        for carry in (False, True):
            rows = [(rnd.randint(0, 6), rnd.randint(0, 8)) for _ in range(40)]
            df = spark.createDataFrame([(i, c, a) for i, (c, a) in enumerate(rows)], "change_rank long, c long, a long")
            got = [r["t"] for r in ds.quota_take(df, ratio, carry).orderBy("change_rank").collect()]
            assert got == seq_take(rows, ratio, carry), (ratio, carry)


def _tables(spark):
    cm = [("c1", 1, 1, "x"), ("c1", 1, 2, "x"), ("c1", 1, 3, "y"), ("c1", 1, 4, "z"), ("c2", 2, 1, "p"), ("c3", 3, 1, "")]
    ln = [("c1", 5, 1, "a"), ("c1", 5, 2, "x"), ("c1", 5, 3, "b"), ("c2", 6, 1, "q"), ("c2", 6, 2, "r"),
          ("c2", 6, 3, "s"), ("c2", 6, 4, "t"), ("c9", 9, 1, "u"), ("c2", 6, 5, None)]
    schema = "change_id string, doc_id long, line_no int, line_contents string"
    return spark.createDataFrame(cm, schema), spark.createDataFrame(ln, schema)


def test_prepare_dataset_small(spark):
    cm, ln = _tables(spark)
    out = ds.prepare_dataset(cm, ln, ["doc_id", "line_no"], ["change_id", "line_contents"])
    rows = sorted((r["change_id"], r["line_contents"], r["commented"]) for r in out.collect())
    # c1: 3 lines -> first 3 commented kept (x, x, y) -> dedup x, y; OK lines a, b (x excluded: Q9 fixed)
    # c2: 1 commented; totals were even after c1, so c2 gives one OK line: q
    assert rows == sorted([("c1", "x", 1), ("c1", "y", 1), ("c1", "a", 0), ("c1", "b", 0),
                           ("c2", "p", 1), ("c2", "q", 0)])


def test_partition_invariance(spark):
    cm, ln = _tables(spark)
    res = []
    for n in (1, 3, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = ds.prepare_dataset(cm.repartition(n), ln.repartition(n), ["doc_id", "line_no"],
                                 ["change_id", "line_contents"])
        res.append(sorted(tuple(r) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1] == res[2]


def test_empty_lines_dropped(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("\t",)], "line_contents string")
    kept = ds.drop_empty_lines(ds.fill_text(df, ["line_contents"])).collect()
    assert sorted(r[0] for r in kept) == ["\t", " "]


def carry_brute(c, a, r, d=0):
    out = []
    for x, y, z in zip(c, a, r):
        out.append(min(y, max(z, x - d)))
        d += out[-1] - x
    return out, d


def test_a_run_of_changes_is_one_function():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.randint(0, 25)
        c = [rnd.randint(0, 6) for _ in range(n)]
        a = [rnd.choice([0, rnd.randint(0, 8), rnd.randint(0, 60)]) for _ in range(n)]
        r = [math.ceil(x * rnd.choice([1.5, 2])) for x in c]
        x, y, shift = ds.carry_function(c, a, r)
        assert len(x) <= 2 * n and all(np.diff(x) > 0) and all(np.isin(np.diff(y) - np.diff(x) * (np.diff(y) > 0), 0))
        for d in range(-80, 81, 3):
            assert ds.carried(x, y, shift, d) == carry_brute(c, a, r, d)[1]


def test_carry_over_many_chunks(spark, monkeypatch):
    """Chunks of 16 changes, ranges of any size: the same as one change after the other; a chunk is all that meets."""
    monkeypatch.setattr(ds, "CARRY_CHUNK", 16)
    rnd = random.Random(2)
    rows = [(f"c{i}", i, rnd.randint(0, 6), rnd.choice([0, rnd.randint(0, 9), 40])) for i in range(700)]
    counts = spark.createDataFrame(rows, "change_id string, change_rank long, c int, a int").repartition(5)
    for ratio in (1.5, 2.0, 3.0):
        got = ds.quota_take(counts, ratio, True)
        want, _ = carry_brute([r[2] for r in rows], [r[3] for r in rows], [math.ceil(r[2] * ratio) for r in rows])
        assert [r["t"] for r in got.orderBy("change_rank").collect()] == want
        assert {"change_id", "c", "a", "t"} <= set(got.columns)
    assert ds.quota_take(counts.limit(0), 2.0, True).count() == 0
