"""Queries for scoring and recommendation (rows 26, 31-35, 86, 93, 94, 99, 101, 102, 106, 108)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as em
from ..operators import labels as lb
from ..operators import learn as ln
from ..operators import recommend as rc
from ..operators import similar as sm
from ..operators.ordering import posexplode_rows
from ..sources import fixtures as fx
from . import review as rv
from . import sqltext as S
from ..session import cut_lineage
from .catalog import register
from .similar_queries import _CUT_SQL, _RANKED_SQL, _pairs_sql, sql_minkowski

W = fx.with_views
PURP, SUBJ = fx.FIXTURE_PURPOSES, fx.FIXTURE_SUBJECTS
IDS = ["doc_id", "line_no"]
CSEQ = ["conv_id", "turn"]
DIM = 64


# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------

def sql_token_vector(t: str, dim: int) -> str:
    """One SHA-256 per 16 components (the hashes are computed once per token)."""
    n_hash = (dim + 15) // 16
    hashes = " || ".join(f"sha256({S.q('#' * m)} || {t})" if m else f"sha256({t})" for m in range(n_hash))
    return (f"list_transform(range(0, {dim}), lambda j: CAST(('0x' || substr(_h, j * 4 + 1, 4))::INTEGER AS DOUBLE) "
            f"/ 65535.0::DOUBLE - 0.5::DOUBLE)").replace("_h", f"({hashes})")


def sql_embed(line: str, dim: int = DIM) -> str:
    part = dim // 2
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * part) + "]"
    vecs = f"list_transform({S.drop_blank(S.vocab_tokens(line))}, lambda t: {sql_token_vector('t', part)})"
    first = f"CASE WHEN len(_v) > 0 THEN _v[1] ELSE {zeros} END"
    mean = (f"CASE WHEN len(_v) > 0 THEN list_transform(list_reduce(_v, lambda acc, v: "
            f"list_transform(list_zip(acc, v), lambda z: z[1] + z[2]), {zeros}), lambda x: x / len(_v)) "
            f"ELSE {zeros} END")
    return vecs, f"CAST(list_concat({first}, {mean}) AS FLOAT[])"


_MODEL_CTES = [
    ("train_toks", f"SELECT commented, unnest({S.vocab_tokens('line_contents')}) AS token FROM v_class"),
    ("model", "SELECT token, CAST(sum(CASE WHEN commented = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0, "
              "CAST(sum(CASE WHEN commented = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM train_toks GROUP BY token"),
    ("priors", "SELECT CAST(sum(CASE WHEN commented = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS p0, "
               "CAST(sum(CASE WHEN commented = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p1 FROM v_class"),
    ("tot", "SELECT sum(n0) AS tn0, sum(n1) AS tn1, CAST(count(*) AS DOUBLE) AS tv FROM model"),
    ("w", "SELECT token, ln((n1 + 1.0) / (tn1 + tv)) - ln((n0 + 1.0) / (tn0 + tv)) AS w FROM model, tot"),
    ("line_toks", f"SELECT doc_id, line_no, unnest({S.vocab_tokens('line_contents')}) AS token FROM v_lines"),
    ("line_sums", "SELECT t.doc_id, t.line_no, sum(coalesce(w.w * t.c, 0.0)) AS s FROM "
                  "(SELECT doc_id, line_no, token, count(*) AS c FROM line_toks GROUP BY ALL) t "
                  "LEFT JOIN w ON t.token = w.token GROUP BY ALL"),
    ("scored", "SELECT l.doc_id, l.line_no, coalesce(l.line_contents, '') AS line_contents, "
               "1.0 / (1.0 + exp(-(coalesce(s.s, 0.0) + (SELECT ln(p1 / (p0 + p1)) - ln(p0 / (p0 + p1)) "
               "FROM priors)))) AS commented_prob FROM v_lines l LEFT JOIN line_sums s "
               "ON l.doc_id = s.doc_id AND l.line_no = s.line_no"),
    ("classified", "SELECT *, CAST(commented_prob >= 0.5 AS INTEGER) AS commented_pred FROM scored"),
]


def _review_ctes():
    vecs, emb = sql_embed("line")
    return _MODEL_CTES + [
        ("flagged", "SELECT DISTINCT line_contents AS line FROM classified WHERE commented_pred = 1"),
        ("emb", f"SELECT line, {emb} AS embedding FROM (SELECT line, {vecs} AS _v FROM flagged)"),
        _CUT_SQL,
        ("rpairs", f"SELECT e.line AS query_line, r.ref_id, r.line AS similar_line, "
                   f"{sql_minkowski('e.embedding', 'r.embedding')} AS distance FROM emb e, v_reference r"),
        ("rsim", "SELECT DISTINCT query_line, similar_line FROM (SELECT *, row_number() OVER (PARTITION BY query_line "
                 "ORDER BY distance, ref_id) AS rk, max(CASE WHEN distance <= (SELECT cut_off FROM cut) THEN 1 ELSE 0 END) "
                 "OVER (PARTITION BY query_line) AS has FROM rpairs) "
                 "WHERE distance <= (SELECT cut_off FROM cut) OR (has = 0 AND rk = 1)"),
        ("rmatched", "SELECT s.query_line, s.similar_line, c.* FROM rsim s LEFT JOIN v_comments c "
                     "ON s.similar_line = c.line_contents"),
        ("ragg", _agg_sql("rmatched")),
        ("reviewed", "SELECT k.doc_id, k.line_no, k.line_contents AS line, k.commented_pred AS decision, "
                     "CASE WHEN k.commented_pred = 1 THEN a.no_similar_lines END AS no_similar_lines, "
                     "CASE WHEN k.commented_pred = 1 THEN a.no_comments END AS no_comments, "
                     + ", ".join(f"CASE WHEN k.commented_pred = 1 THEN a.{c} END AS {c}" for c in PURP + SUBJ) + ", "
                     "CASE WHEN k.commented_pred = 1 THEN coalesce(a.messages, '') ELSE '' END AS messages, "
                     "CASE WHEN k.commented_pred = 1 THEN coalesce(a.lines, '') ELSE '' END AS lines "
                     "FROM classified k LEFT JOIN ragg a ON k.line_contents = a.query_line"),
    ]


def _agg_sql(src: str) -> str:
    n = "sum(CASE WHEN line_contents IS NOT NULL THEN 1 ELSE 0 END)"
    cols = [f"count(DISTINCT similar_line) AS no_similar_lines", f"CAST({n} AS BIGINT) AS no_comments"]
    cols += [f"CASE WHEN {n} = 0 THEN 0.0 ELSE CAST(sum(CASE WHEN purpose = {S.q(p)} THEN 1 ELSE 0 END) AS DOUBLE) "
             f"/ CAST({n} AS DOUBLE) END AS {p}" for p in PURP]
    cols += [f"CASE WHEN {n} = 0 THEN NULL ELSE sum(CASE WHEN line_contents IS NOT NULL THEN coalesce({s}, 0.0) "
             f"ELSE 0.0 END) / CAST({n} AS DOUBLE) END AS {s}" for s in SUBJ]
    cols += ["coalesce(string_agg(message, ' ||| ' ORDER BY conv_id, turn), '') AS messages",
             "coalesce(string_agg(line_contents, ' ||| ' ORDER BY conv_id, turn), '') AS lines"]
    return f"SELECT query_line, {', '.join(cols)} FROM {src} GROUP BY query_line"


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def _model(spark, sf):
    # a trained model is an artifact: materialized once (shared checkpoint folder)
    return cut_lineage(ln.train_binary(fx.v_class(spark, sf), "line_contents", "commented"))


def _reviewed(spark, sf):
    return rv.review(fx.v_lines(spark, sf), _model(spark, sf), fx.v_reference(spark, sf), fx.v_comments(spark, sf),
                     PURP, SUBJ, IDS, CSEQ)


def _round(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("train_lines", W("SELECT token, n0, n1 FROM model UNION ALL SELECT NULL, p0, p1 FROM priors", *_MODEL_CTES))
def q_train_lines(spark, sf):
    return _model(spark, sf)


@register("line_weights", W(
    "SELECT commented, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM "
    "(SELECT commented, count(*) AS n FROM v_class GROUP BY commented)"))
def q_line_weights(spark, sf):
    return lb.class_weights(fx.v_class(spark, sf), "commented")


@register("classify_lines", W(
    "SELECT doc_id, line_no, round(commented_prob, 6) AS commented_prob, commented_pred FROM classified", *_MODEL_CTES))
def q_classify(spark, sf):
    c = ln.classify_lines(fx.v_lines(spark, sf), _model(spark, sf), IDS)
    return c.select("doc_id", "line_no", F.round("commented_prob", 6).alias("commented_prob"), "commented_pred")


_VECS, _EMB = sql_embed("line")


@register("embed_lines", W(
    "SELECT line, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, "
    "round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0::DOUBLE AS value FROM "
    f"(SELECT line, {_EMB} AS embedding FROM (SELECT line, {_VECS} AS _v FROM "
    "(SELECT DISTINCT line_contents AS line FROM v_class)))"))
def q_embed(spark, sf):
    e = em.embed_lines(fx.v_class(spark, sf), "line_contents", dim=DIM)
    return posexplode_rows(e, ["line"], F.col("embedding"), "j", "value") \
        .select("line", "j", (F.round(F.col("value").cast("double"), 6) + F.lit(0.0)).alias("value"))


def _pool_sql(kind: str) -> str:
    part = 8
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * part) + "]"
    if kind == "first":
        return f"CASE WHEN len(_v) > 0 THEN _v[1] ELSE {zeros} END"
    if kind == "mean":
        return (f"list_transform(list_reduce(_v, lambda acc, v: list_transform(list_zip(acc, v), "
                f"lambda z: z[1] + z[2]), {zeros}), lambda x: x / len(_v))")
    return (f"list_reduce(_v, lambda acc, v: list_transform(list_zip(acc, v), lambda z: greatest(z[1], z[2])), "
            f"[{', '.join(['-1e308::DOUBLE'] * part)}])")


@register("pool_vectors", W(
    "SELECT line, pool, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS j, round(unnest(vec), 6) + 0.0::DOUBLE AS value FROM ("
    f"SELECT line, 'first' AS pool, {_pool_sql('first')} AS vec FROM v UNION ALL "
    f"SELECT line, 'mean' AS pool, {_pool_sql('mean')} AS vec FROM v UNION ALL "
    f"SELECT line, 'max' AS pool, {_pool_sql('max')} AS vec FROM v)",
    ("v", f"SELECT line, list_transform({S.drop_blank(S.vocab_tokens('line'))}, lambda t: {sql_token_vector('t', 8)}) "
          f"AS _v FROM (SELECT DISTINCT line_contents AS line FROM v_class) "
          f"WHERE len({S.drop_blank(S.vocab_tokens('line'))}) > 0")))
def q_pool(spark, sf):
    from ..functions.vectors import pool_first, pool_max, pool_mean
    lines = fx.v_class(spark, sf).select(F.col("line_contents").alias("line")).distinct()
    v = em.line_token_vectors(lines, F.col("line"), 8, "_v").where(F.size("_v") > 0)
    out = v.select("line", F.explode(F.array(
        F.struct(F.lit("first").alias("pool"), pool_first("_v").alias("vec")),
        F.struct(F.lit("mean").alias("pool"), pool_mean("_v").alias("vec")),
        F.struct(F.lit("max").alias("pool"), pool_max("_v").alias("vec")))).alias("p"))
    return posexplode_rows(out.select("line", "p.pool", "p.vec"), ["line", "pool"], F.col("vec"), "j", "value") \
        .select("line", "pool", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))


# --- rows 26, 32-35 on the stand-in query vectors -----------------------------

_LOOKUP_CTES = [_pairs_sql(), _CUT_SQL, _RANKED_SQL,
                ("lookup", "SELECT query_line, similar_line FROM ranked WHERE distance <= (SELECT cut_off FROM cut) "
                           "OR (rank = 1 AND query_id NOT IN (SELECT query_id FROM pairs WHERE distance <= "
                           "(SELECT cut_off FROM cut)))"),
                ("matched", "SELECT s.query_line, s.similar_line, c.* FROM (SELECT DISTINCT query_line, similar_line "
                            "FROM lookup) s LEFT JOIN v_comments c ON s.similar_line = c.line_contents"),
                ("agg", _agg_sql("matched"))]


def _lookup(spark, sf):
    q = fx.v_queries(spark, sf)
    refs = fx.v_reference(spark, sf)
    cells = sm.reference_cells(refs)
    pairs = sm.similar_pairs(q.select("query_id", "embedding"), cells, sm.similarity_cutoff(refs, 50, cells=cells))
    return (pairs.join(q.select("query_id", "query_line"), "query_id")
            .join(refs.select("ref_id", F.col("line").alias("similar_line")), "ref_id"))


def _matched(spark, sf):
    return rc.comments_for_similar(_lookup(spark, sf), fx.v_comments(spark, sf))


def _agg(spark, sf):
    return rc.aggregate_comments(_lookup(spark, sf), fx.v_comments(spark, sf), PURP, SUBJ, CSEQ)


@register("comments_for_similar", W("SELECT query_line, similar_line, conv_id, turn FROM matched", *_LOOKUP_CTES))
def q_cfs(spark, sf):
    return _matched(spark, sf).select("query_line", "similar_line", "conv_id", "turn")


@register("purpose_shares", W(f"SELECT query_line, {_r6(PURP)} FROM agg", *_LOOKUP_CTES))
def q_purpose_shares(spark, sf):
    return _round(_agg(spark, sf).select("query_line", *PURP), PURP)


@register("subject_shares", W(f"SELECT query_line, {_r6(SUBJ)} FROM agg", *_LOOKUP_CTES))
def q_subject_shares(spark, sf):
    return _round(_agg(spark, sf).select("query_line", *SUBJ), SUBJ)


@register("match_counts", W("SELECT query_line, no_similar_lines, no_comments FROM agg", *_LOOKUP_CTES))
def q_match_counts(spark, sf):
    return _agg(spark, sf).select("query_line", "no_similar_lines", "no_comments")


@register("message_digest", W("SELECT query_line, messages, lines FROM agg", *_LOOKUP_CTES))
def q_digest(spark, sf):
    return _agg(spark, sf).select("query_line", "messages", "lines")


# --- rows 101, 102, 108 ---------------------------------------------------------

@register("review", W(f"SELECT doc_id, line_no, line, decision, no_similar_lines, no_comments, "
                      f"{_r6(PURP + SUBJ)}, messages, lines FROM reviewed", *_review_ctes()))
def q_review(spark, sf):
    return _round(_reviewed(spark, sf), PURP + SUBJ)


@register("review_report", W(f"SELECT doc_id, line_no, line, decision, {_r6(PURP + SUBJ)}, messages, lines "
                             f"FROM reviewed", *_review_ctes()))
def q_review_report(spark, sf):
    return _round(rv.review_report(_reviewed(spark, sf), IDS, PURP, SUBJ), PURP + SUBJ)


def _badges_sql() -> str:
    shown = [p for p in PURP]
    arms = [f"SELECT doc_id, line_no, 'purpose' AS kind, {S.q(p)} AS label, {p} AS share FROM reviewed "
            f"WHERE decision = 1" for p in shown]
    arms += [f"SELECT doc_id, line_no, 'subject' AS kind, {S.q(s)} AS label, {s} AS share FROM reviewed "
             f"WHERE decision = 1" for s in SUBJ]
    return ("SELECT doc_id, line_no, kind, label, round_even(share * 100.0::DOUBLE * 10.0::DOUBLE, 0) / 10.0::DOUBLE "
            "AS pct FROM (" + " UNION ALL ".join(arms) + ") WHERE share > 0")


@register("report_badges", W(_badges_sql(), *_review_ctes()))
def q_badges(spark, sf):
    return rv.badges(_reviewed(spark, sf), IDS, PURP, SUBJ, PURP)
