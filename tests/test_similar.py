"""Rows 27-29, 51, 64: metric cells against brute force, and the work they save."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import similar as sm


def _data(spark, nq=23, nr=57, d=8, seed=3):
    rnd = np.random.default_rng(seed)
    Q = rnd.normal(size=(nq, d)).astype(np.float32)
    R = rnd.normal(size=(nr, d)).astype(np.float32)
    R[5] = R[6]          # duplicate vectors
    Q[0] = R[10]         # a query equal to a reference
    q = spark.createDataFrame([(i, Q[i].tolist()) for i in range(nq)], "query_id long, embedding array<float>")
    r = spark.createDataFrame([(i, R[i].tolist()) for i in range(nr)], "ref_id long, embedding array<float>")
    return Q.astype(np.float64), R.astype(np.float64), q, r


def brute(Q, R, p=6):
    return (np.abs(Q[:, None, :] - R[None, :, :]) ** p).sum(-1) ** (1.0 / p)


def test_knn_every_block_size(spark):
    Q, R, q, r = _data(spark)
    D = brute(Q, R)
    want = {i: [int(j) for j in np.lexsort((np.arange(R.shape[0]), D[i]))[:4]] for i in range(Q.shape[0])}
    for qb, rb in [(1, 1), (5, 7), (100, 100), (3, 57)]:
        got = sm.knn_join(q, r, 4, query_block=qb, ref_block=rb).collect()
        m = {}
        for row in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
            m.setdefault(row["query_id"], []).append(row["ref_id"])
        assert m == want, (qb, rb)


def test_radius_and_fallback(spark):
    Q, R, q, r = _data(spark)
    D = brute(Q, R)
    cut = float(np.percentile(D, 5))
    got = sm.similar_pairs(q, r, cut, at_least_one_result=True, query_block=4, ref_block=9).collect()
    m = {}
    for row in got:
        m.setdefault(row["query_id"], set()).add(row["ref_id"])
    for i in range(Q.shape[0]):
        inr = set(np.nonzero(D[i] <= cut)[0].tolist())
        if not inr:
            inr = {int(np.lexsort((np.arange(R.shape[0]), D[i]))[0])}
        assert m[i] == inr


def test_cutoff_matches_numpy(spark):
    Q, R, q, r = _data(spark)
    D = brute(R, R)
    second = np.sort(D, axis=1)[:, 1]
    want = float(np.percentile(second, 50))
    assert abs(sm.similarity_cutoff(r, 50, ref_block=11) - want) < 1e-9
    assert abs(sm.similarity_cutoff(r, 50, sample=10_000, pivots=1) - want) < 1e-9
    some = [x["ref_id"] for x in sm.cutoff_sample(r, 20).collect()]
    assert abs(sm.similarity_cutoff(r, 80, sample=20) - float(np.percentile(second[some], 80))) < 1e-9


def test_manhattan_metric(spark):
    Q, R, q, r = _data(spark)
    D = np.abs(Q[:, None, :] - R[None, :, :]).sum(-1)
    got = sm.nearest_line(q, r, metric="manhattan").collect()
    for row in got:
        i = row["query_id"]
        assert row["ref_id"] == int(np.lexsort((np.arange(R.shape[0]), D[i]))[0])


def clustered(spark, seed=7, clusters=20, each=60, d=6):
    """References in tight clusters, a third of them one and the same vector, and queries near some clusters."""
    rnd = np.random.default_rng(seed)
    at = rnd.normal(size=(clusters, d)) * 20
    R = (at[:, None, :] + rnd.normal(size=(clusters, each, d)) * 0.2).reshape(-1, d).astype(np.float32)
    R = R[rnd.permutation(len(R))]
    R[::3] = R[0]
    Q = (at[rnd.integers(0, clusters, 50)] + rnd.normal(size=(50, d)) * 0.2).astype(np.float32)
    Q[:4] = R[0]
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, embedding array<float>")
    return Q.astype(float), R.astype(float), frame(Q, "query_id"), frame(R, "ref_id")


def minkowski(Q, R, p):
    d = np.abs(Q[:, None, :] - R[None, :, :])
    return d.max(-1) if math.isinf(p) else (d ** p).sum(-1) ** (1 / p)


@pytest.mark.parametrize("metric", [1, 2, 3.5, None, math.inf])
def test_clusters_and_copies_every_metric(spark, metric):
    Q, R, q, r = clustered(spark)
    D = minkowski(Q, R, 6 if metric is None else metric)
    cells = sm.reference_cells(r, metric, ref_block=32)
    assert cells.counts.sum() == len(R) and sum(x["n"] for x in cells.directory().collect()) == len(R)
    got = sorted((x["query_id"], x["rank"], x["ref_id"]) for x in sm.knn_join(q, cells, 7, query_block=16).collect())
    assert got == [(i, k + 1, int(j)) for i in range(len(Q)) for k, j in enumerate(np.lexsort((np.arange(len(R)), D[i]))[:7])]
    cut = float(np.percentile(D, 3))
    got = {(x["query_id"], x["ref_id"]) for x in sm.radius_join(q, cells, cut).collect()}
    assert got == set(map(tuple, np.argwhere(D <= cut).tolist()))
    few = {(x["query_id"], x["rank"], x["ref_id"]) for x in sm.radius_join(q, cells, cut, max_similar=2).collect()}
    assert few == {(i, k + 1, int(j)) for i in range(len(Q)) for k, j in enumerate(np.lexsort((np.arange(len(R)), D[i]))[:2]) if D[i, j] <= cut}


def test_queries_go_to_few_blocks(spark):
    """Copies of queries: with clusters a query reaches a small part of the blocks, one block holds one cell, and the
    copies of one vector are many blocks of bounded size."""
    Q, R, q, r = clustered(spark)
    cells = sm.reference_cells(r, ref_block=32)
    blocks = cells.blocks.select("cell", "n", "lo", "hi").collect()
    assert max(b["n"] for b in blocks) <= 32 and all(b["lo"] <= b["hi"] for b in blocks)
    assert sum(b["hi"] == 0 for b in blocks) >= len(R) / 3 / 32 - 1  # the copies are a pivot
    copies = sm.routed(q.select("query_id", "embedding", F.lit(0.5).alias("radius")), cells).groupBy("query_id").count().collect()
    far = [c["count"] for c in copies if c["query_id"] >= 4]
    assert np.mean(far) < 0.25 * len(blocks)
    every = sm.routed(q.select("query_id", "embedding", F.lit(1e9).alias("radius")), cells)
    assert every.count() == len(Q) * len(blocks)


def test_odd_vectors_and_small_tables(spark):
    s = "embedding array<double>"
    r = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [3.0, 4.0])], "ref_id long, " + s)
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (9, [math.nan, 0.0])], "query_id long, " + s)
    got = sm.knn_join(q, r, 5, metric=2).collect()
    assert sorted((x["query_id"], x["ref_id"], x["distance"]) for x in got) == [(7, 1, 0.0), (7, 5, 5.0)]
    assert sm.similar_pairs(q, r, 0.1, metric="l2").count() == 1
    assert sm.knn_join(q, r.limit(0), 2).count() == 0 and sm.similarity_cutoff(r.limit(0), 50) is None
    assert sm.radius_join(q.limit(0), r, 9.0).count() == 0
    with pytest.raises(ValueError):
        sm.reference_cells(r, metric=0.5)
    with pytest.raises(ValueError):
        sm.similar_pairs(q, r, None)


def test_exact_quantile(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(size=3001), 1)  # many ties
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(7)
    for at in (0, 0.1, 0.5, 0.777, 1):
        for few in (1, 50, 1 << 16):
            assert abs(sm.exact_quantile(df, "v", at, bins=8, few=few) - np.quantile(x, at)) < 1e-12
    assert sm.exact_quantile(df.limit(0), "v", 0.5) is None


@pytest.mark.parametrize("scale", [1e-9, 1.0, 3e7, 1e40])
def test_products_of_powers_lose_no_pair(spark, scale):
    """Candidates come from products in single precision; results are those of brute force, near ties, copies and
    vectors of very unlike size included, in groups of few blocks."""
    rnd = np.random.default_rng(11)
    R = rnd.normal(size=(300, 7))
    R[100:200] = R[:100] + rnd.normal(size=(100, 7)) * 1e-7
    R[200:210] *= 1e-6
    R[210:220] = R[3]
    Q = np.vstack([R[:20] + 1e-8, R[200:205], rnd.normal(size=(15, 7)), rnd.normal(size=(5, 7)) * 1e3])
    Q, R = Q * scale, R * scale
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, embedding array<double>")
    q, r = frame(Q, "query_id"), frame(R, "ref_id")
    for p in (2, 6):
        D = sm.distances(Q, R, p)
        assert all((sm.pair_distances(Q[[i] * len(R)], R, p) == D[i]).all() for i in range(len(Q)))
        cells = sm.reference_cells(r, p, ref_block=16, group_bytes=40 * 7 * 8)
        got = {(x["query_id"], x["rank"], x["ref_id"], x["distance"]) for x in sm.knn_join(q, cells, 3, query_block=9).collect()}
        assert got == {(i, k + 1, int(j), D[i, j]) for i in range(len(Q)) for k, j in enumerate(np.lexsort((np.arange(len(R)), D[i]))[:3])}
        cut = float(np.quantile(D[:20], 0.3))
        assert {(x["query_id"], x["ref_id"]) for x in sm.radius_join(q, cells, cut).collect()} == set(map(tuple, np.argwhere(D <= cut).tolist()))


def test_a_query_is_sent_once_to_a_group(spark):
    Q, R, q, r = clustered(spark)
    cells = sm.reference_cells(r, ref_block=32, group_bytes=300 * 6 * 8)
    n_groups, n_blocks = len(cells.starts), cells.blocks.count()
    assert n_groups <= 8 < n_blocks
    asked = sm._usable(q.select("query_id", "embedding", F.lit(1e9).alias("radius")), "query_id", "radius")
    assert asked.mapInArrow(sm._group_router(cells), sm._SENT).count() == n_groups * len(Q)
    near = sm._usable(q.where("query_id >= 4").select("query_id", "embedding", F.lit(0.5).alias("radius")), "query_id", "radius")
    assert near.mapInArrow(sm._group_router(cells), sm._SENT).count() <= 2 * (len(Q) - 4)  # cells next to each other are close by
