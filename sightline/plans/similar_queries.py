"""Queries for the similarity rows (27-29, 51, 62, 64, 85, 100, 107)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.vectors import minkowski
from ..operators import similar as sm
from ..sources import fixtures as fx
from .catalog import register

W = fx.with_views
PCT = 50


def sql_minkowski(a: str, b: str, p: float = 6) -> str:
    """Left fold over dimensions in double, like the Spark side."""
    terms = f"list_transform(list_zip({a}, {b}), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))"
    if math.isinf(p):
        return f"list_reduce({terms}, lambda acc, d: greatest(acc, d), 0.0::DOUBLE)"
    if p == 1:
        return f"list_reduce({terms}, lambda acc, d: acc + d, 0.0::DOUBLE)"
    return f"pow(list_reduce({terms}, lambda acc, d: acc + pow(d, {float(p)}), 0.0::DOUBLE), {1.0 / p!r})"


def _pairs_sql(p: float = 6) -> tuple[str, str]:
    return ("pairs", f"SELECT q.query_id, q.query_line, r.ref_id, r.line AS similar_line, "
                     f"{sql_minkowski('q.embedding', 'r.embedding', p)} AS distance FROM v_queries q, v_reference r")


_CUT_SQL = ("cut", f"""
    SELECT quantile_cont(distance, {PCT / 100.0}) AS cut_off FROM (
      SELECT s.ref_id, r.ref_id AS other, {sql_minkowski('s.embedding', 'r.embedding')} AS distance,
             row_number() OVER (PARTITION BY s.ref_id ORDER BY {sql_minkowski('s.embedding', 'r.embedding')}, r.ref_id) AS rk
      FROM v_reference s, v_reference r) WHERE rk = 2""")

_RANKED_SQL = ("ranked", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs")


def _refs(spark, sf):
    return fx.v_reference(spark, sf)


def _queries(spark, sf):
    return fx.v_queries(spark, sf)


def _within(spark, sf, join, **kw):
    """``join`` within the cut-off; the cells of the references serve both."""
    refs = _refs(spark, sf)
    cells = sm.reference_cells(refs)
    return join(_queries(spark, sf), cells, sm.similarity_cutoff(refs, PCT, cells=cells), **kw)


def _out(df):
    return df.select("query_id", "ref_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


@register("minkowski", W(
    f"SELECT a.vec_id AS vec_id, "
    f"round({sql_minkowski('a.embedding', 'b.embedding', 1)}, 6) AS d_p1, "
    f"round({sql_minkowski('a.embedding', 'b.embedding', 2)}, 6) AS d_p2, "
    f"round({sql_minkowski('a.embedding', 'b.embedding', 6)}, 6) AS d_p6, "
    f"round({sql_minkowski('a.embedding', 'b.embedding', math.inf)}, 6) AS d_inf "
    f"FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))
def q_minkowski(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", *[F.round(minkowski("embedding", "e2", p), 6).alias(n)
                                for p, n in [(1, "d_p1"), (2, "d_p2"), (6, "d_p6"), (math.inf, "d_inf")]])


@register("similarity_cutoff", W("SELECT round(cut_off, 6) AS cut_off FROM cut", _CUT_SQL))
def q_cutoff(spark, sf):
    cut = sm.similarity_cutoff(_refs(spark, sf), PCT)
    return spark.range(1).select(F.round(F.lit(cut), 6).alias("cut_off"))


@register("radius_join", W(
    "SELECT query_id, ref_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked "
    "WHERE distance <= (SELECT cut_off FROM cut)", _pairs_sql(), _CUT_SQL, _RANKED_SQL))
def q_radius(spark, sf):
    return _out(_within(spark, sf, sm.radius_join))


@register("knn_join", W(
    "SELECT query_id, ref_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
    _pairs_sql(), _RANKED_SQL))
def q_knn(spark, sf):
    return _out(sm.knn_join(_queries(spark, sf), _refs(spark, sf), 5))


@register("rank_neighbours", W(
    "SELECT query_id, ref_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs "
    " WHERE distance <= (SELECT cut_off FROM cut)) WHERE rank <= 3", _pairs_sql(), _CUT_SQL))
def q_rank_neighbours(spark, sf):
    return _out(_within(spark, sf, sm.radius_join, max_similar=3))


@register("nearest_line", W(
    "SELECT query_id, ref_id, round(distance, 6) AS distance FROM ranked WHERE rank = 1", _pairs_sql(), _RANKED_SQL))
def q_nearest(spark, sf):
    n = sm.nearest_line(_queries(spark, sf), _refs(spark, sf))
    return n.select("query_id", "ref_id", F.round("distance", 6).alias("distance"))


@register("custom_metric", W(
    "SELECT query_id, ref_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) WHERE rank <= 3",
    _pairs_sql(1)))
def q_custom_metric(spark, sf):
    return _out(sm.knn_join(_queries(spark, sf), _refs(spark, sf), 3, metric="manhattan"))


@register("similar_lookup", W(
    "SELECT query_line, similar_line, round(distance, 6) AS distance FROM ranked "
    "WHERE distance <= (SELECT cut_off FROM cut) OR (rank = 1 AND query_id NOT IN "
    "(SELECT query_id FROM pairs WHERE distance <= (SELECT cut_off FROM cut)))",
    _pairs_sql(), _CUT_SQL, _RANKED_SQL))
def q_similar_lookup(spark, sf):
    q = _queries(spark, sf)
    # one query per distinct line text (ids stand for the text)
    distinct = q.groupBy("query_line").agg(F.min("query_id").alias("query_id"))
    qd = q.join(distinct, ["query_line", "query_id"], "left_semi")
    refs = _refs(spark, sf)
    cells = sm.reference_cells(refs)
    pairs = sm.similar_pairs(qd.select("query_id", "embedding"), cells, sm.similarity_cutoff(refs, PCT, cells=cells))
    r = refs.select("ref_id", F.col("line").alias("similar_line"))
    return pairs.join(qd.select("query_id", "query_line"), "query_id").join(r, "ref_id") \
        .select("query_line", "similar_line", F.round("distance", 6).alias("distance"))


@register("find_similar", W(
    "SELECT query_line, similar_line, round(distance, 6) AS distance FROM pairs "
    "WHERE distance <= (SELECT cut_off FROM cut)", _pairs_sql(), _CUT_SQL))
def q_find_similar(spark, sf):
    from .similar_jobs import find_similar
    return find_similar(_refs(spark, sf), _queries(spark, sf), cut_off_percentile=PCT).select("query_line", "similar_line", F.round("distance", 6).alias("distance"))
