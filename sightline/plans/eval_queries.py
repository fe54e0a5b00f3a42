"""Queries for labels, weights and evaluation (rows 31, 41, 43-50, 80-82, 92, 95, 97)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import vocab_tokens
from ..operators import labels as lb
from ..operators import learn as ln
from ..operators import metrics as mt
from ..schemas import PURPOSE_LABELS, SUBJECT_COLUMNS
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import jobs
from . import sqltext as S
from .catalog import register
from .recommend_queries import _MODEL_CTES

W = fx.with_views
PURP, SUBJ = fx.FIXTURE_PURPOSES, fx.FIXTURE_SUBJECTS
METRICS = ["accuracy", "precision", "recall", "f1", "mcc"]


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _round(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _cm_sql(src: str, t: str, p: str, key: str | None = None, labels_sql: str | None = None) -> str:
    k = f"{key}, " if key else ""
    kj = f"g.{key} = c.{key} AND " if key else ""
    labs = labels_sql or (f"SELECT DISTINCT {k}l FROM (SELECT {k}{t} AS l FROM {src} WHERE {t} IS NOT NULL "
                          f"UNION ALL SELECT {k}{p} AS l FROM {src} WHERE {t} IS NOT NULL)")
    grid = (f"SELECT {('a.' + key + ', ') if key else ''}a.l AS t, b.l AS p FROM ({labs}) a JOIN ({labs}) b "
            f"ON {('a.' + key + ' = b.' + key) if key else 'TRUE'}")
    counts = f"SELECT {k}{t} AS t, {p} AS p, count(*) AS n FROM {src} WHERE {t} IS NOT NULL GROUP BY ALL"
    return (f"SELECT {('g.' + key + ', ') if key else ''}g.t, g.p, coalesce(c.n, 0) AS n, "
            f"CAST(coalesce(c.n, 0) AS DOUBLE) / nullif(CAST(sum(coalesce(c.n, 0)) OVER "
            f"(PARTITION BY {('g.' + key + ', ') if key else ''}g.t) AS DOUBLE), 0) AS share "
            f"FROM ({grid}) g LEFT JOIN ({counts}) c ON {kj}g.t = c.t AND g.p = c.p")


def _scores_sql(cm: str, key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    per = (f"SELECT {k}l, sum(tc) AS tc, sum(pc) AS pc, sum(tp) AS tp FROM ("
           f"SELECT {k}t AS l, n AS tc, 0 AS pc, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM ({cm}) UNION ALL "
           f"SELECT {k}p AS l, 0 AS tc, n AS pc, 0 AS tp FROM ({cm})) GROUP BY ALL HAVING sum(tc) > 0 OR sum(pc) > 0")
    pr = (f"SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(pc AS DOUBLE), 0), 0.0) AS pp_, "
          f"coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tc AS DOUBLE), 0), 0.0) AS rr_ FROM ({per})")
    f1 = f"SELECT *, coalesce(2 * pp_ * rr_ / nullif(pp_ + rr_, 0), 0.0) AS ff_ FROM ({pr})"
    agg = (f"SELECT {k}CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(tc) AS DOUBLE) AS s, "
           f"sum(CAST(pc AS DOUBLE) * tc) AS pt, sum(CAST(pc AS DOUBLE) * pc) AS ppp, sum(CAST(tc AS DOUBLE) * tc) AS ttt, "
           f"avg(pp_) AS precision, avg(rr_) AS recall, avg(ff_) AS f1 FROM ({f1}) GROUP BY ALL")
    return (f"SELECT {k}c / s AS accuracy, precision, recall, f1, CASE WHEN (s * s - ppp) * (s * s - ttt) = 0 THEN 0.0 "
            f"ELSE (c * s - pt) / sqrt((s * s - ppp) * (s * s - ttt)) END AS mcc FROM ({agg})")


@register("confusion_matrix", W(f"SELECT t, p, n, round(share, 6) AS share FROM ({_cm_sql('v_predictions', 'commented', 'pred')})"))
def q_cm(spark, sf):
    return _round(mt.confusion_counts(fx.v_predictions(spark, sf), "commented", "pred"), ["share"])


@register("binary_report", W(f"SELECT {_r6(METRICS)} FROM ({_scores_sql(_cm_sql('v_predictions', 'commented', 'pred'))})"))
def q_binary_report(spark, sf):
    return _round(mt.binary_report(fx.v_predictions(spark, sf), "commented", "pred"), METRICS)


_TALL_SUBJ = " UNION ALL ".join(
    f"SELECT '{s}' AS subject, CAST(coalesce({s}, 0.0) AS INTEGER) AS t, CAST(coalesce(pred_{s}, 0.0) AS INTEGER) AS p "
    f"FROM v_comment_preds" for s in SUBJ)


@register("multilabel_confusion", W(
    "SELECT subject, t, p, n, round(share, 6) AS share FROM (" + _cm_sql(
        "tall", "t", "p", "subject", "SELECT DISTINCT subject, unnest([0, 1]) AS l FROM tall") + ")",
    ("tall", _TALL_SUBJ)))
def q_mlcm(spark, sf):
    d = fx.v_comment_preds(spark, sf)
    return _round(mt.multilabel_confusion(d, SUBJ, ["pred_" + s for s in SUBJ]), ["share"])


_TALL_TARGETS = ("SELECT 'purpose' AS target, purpose AS t, pred_purpose AS p FROM v_comment_preds UNION ALL " + " UNION ALL ".join(
    f"SELECT '{s}' AS target, CAST(CAST(coalesce({s}, 0.0) AS INTEGER) AS VARCHAR) AS t, "
    f"CAST(CAST(coalesce(pred_{s}, 0.0) AS INTEGER) AS VARCHAR) AS p FROM v_comment_preds" for s in SUBJ))
_REPORT_SQL = _scores_sql(_cm_sql("tall", "t", "p", "target"), "target")


def _report(spark, sf):
    d = fx.v_comment_preds(spark, sf)
    return mt.comment_report(d, "purpose", "pred_purpose", SUBJ, ["pred_" + s for s in SUBJ])


@register("comment_report", W(f"SELECT target, {_r6(METRICS)} FROM ({_REPORT_SQL})", ("tall", _TALL_TARGETS)))
def q_comment_report(spark, sf):
    return _round(_report(spark, sf), METRICS)


_SHORT = [("accuracy", "acc"), ("precision", "prec"), ("recall", "rec"), ("f1", "f1"), ("mcc", "mcc")]
_WIDE_COLS = [f"p_{sh}" for _, sh in _SHORT] + [f"s_{s}_{sh}" for s in SUBJ for _, sh in _SHORT]


@register("comment_report_wide", W(
    "SELECT 'fixture' AS name, " + ", ".join(
        [f"round(max(CASE WHEN target = 'purpose' THEN {m} END), 6) AS p_{sh}" for m, sh in _SHORT]
        + [f"round(max(CASE WHEN target = '{s}' THEN {m} END), 6) AS s_{s}_{sh}" for s in SUBJ for m, sh in _SHORT])
    + f" FROM ({_REPORT_SQL})", ("tall", _TALL_TARGETS)))
def q_comment_report_wide(spark, sf):
    return _round(mt.comment_report_wide(_report(spark, sf), SUBJ, "fixture"), _WIDE_COLS)


_LEN_SQL = ("lens", f"SELECT CAST(len({S.vocab_tokens('message')}) AS BIGINT) AS n_tokens FROM v_comments")


def _lens(spark, sf):
    return fx.v_comments(spark, sf).select(F.size(vocab_tokens(F.col("message"))).cast("long").alias("n_tokens"))


@register("length_percentiles", W(
    "SELECT " + ", ".join(f"round(quantile_cont(n_tokens, {p / 100.0}), 6) AS p{p}" for p in (90, 95, 98, 99, 100))
    + " FROM lens", _LEN_SQL))
def q_len_pct(spark, sf):
    out = mt.length_percentiles(_lens(spark, sf), "n_tokens")
    return _round(out, [f"p{p}" for p in (90, 95, 98, 99, 100)])


@register("percentile_of_score", W(
    "SELECT round(CAST(count_if(n_tokens < 128) + count_if(n_tokens <= 128) + CASE WHEN count_if(n_tokens <= 128) > "
    "count_if(n_tokens < 128) THEN 1 ELSE 0 END AS DOUBLE) * (50.0 / count(n_tokens)), 6) AS percentile FROM lens",
    _LEN_SQL))
def q_pct_score(spark, sf):
    return _round(mt.percentile_of_score(_lens(spark, sf), "n_tokens", 128), ["percentile"])


_PURP_IN = ", ".join(S.q(p) for p in PURP)


@register("purpose_weights", W(
    "SELECT purpose, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM "
    f"(SELECT purpose, count(*) AS n FROM v_comments WHERE purpose IN ({_PURP_IN}) GROUP BY purpose)"))
def q_purpose_weights(spark, sf):
    c = fx.v_comments(spark, sf).where(F.col("purpose").isin(PURP))
    return _round(lb.class_weights(c, "purpose"), ["weight"])


_SW_TALL = " UNION ALL ".join(f"SELECT '{s}' AS subject, coalesce({s}, 0.0)::DOUBLE AS value FROM v_comments" for s in SUBJ)


@register("subject_weights", W(
    "SELECT subject, value, n, round(weight, 6) AS weight, round(sw, 6) AS subject_weight, round(weight * sw, 6) AS product "
    "FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY subject) AS DOUBLE) / (count(*) OVER (PARTITION BY subject) * n) AS weight, "
    f"sum(value * n) OVER () / nullif(sum(value * n) OVER (PARTITION BY subject) * {len(SUBJ)}, 0) AS sw "
    "FROM (SELECT subject, value, count(*) AS n FROM tall GROUP BY ALL))", ("tall", _SW_TALL)))
def q_subject_weights(spark, sf):
    return _round(lb.subject_weights(fx.v_comments(spark, sf), SUBJ), ["weight", "subject_weight", "product"])


@register("encode_purpose", W(
    "SELECT conv_id, turn, CAST(list_position([" + _PURP_IN + "], purpose) - 1 AS INTEGER) AS purpose_code, "
    + ", ".join(f"CAST(coalesce(purpose = {S.q(p)}, false) AS INTEGER) AS is_{p}" for p in PURP) + " FROM v_comments"))
def q_encode_purpose(spark, sf):
    c = fx.v_comments(spark, sf)
    c = lb.purpose_one_hot(c, "purpose", PURP, prefix="is_")
    return c.select("conv_id", "turn", lb.purpose_code("purpose", PURP).alias("purpose_code"), *[f"is_{p}" for p in PURP])


@register("encode_subjects", W("SELECT " + ", ".join(f"coalesce({s}, 0.0)::DOUBLE AS {s}" for s in SUBJ) + " FROM v_comments"))
def q_encode_subjects(spark, sf):
    return lb.encode_subjects(fx.v_comments(spark, sf), SUBJ)


def _score_arr_spark():
    return F.array(*[fx.md5_bucket(F.col("conv_id") * 1000 + F.col("turn") * 10 + i, 7) for i in range(len(PURP))])


@register("decode_purpose", W(
    "SELECT conv_id, turn, [" + _PURP_IN + "][list_position(sc, list_max(sc))] AS predicted FROM "
    "(SELECT conv_id, turn, [" + ", ".join(S.md5_bucket(f"conv_id * 1000 + turn * 10 + {i}", 7) for i in range(len(PURP)))
    + "] AS sc FROM v_comments)"))
def q_decode_purpose(spark, sf):
    c = fx.v_comments(spark, sf)
    return c.select("conv_id", "turn", lb.decode_purpose(_score_arr_spark(), PURP).alias("predicted"))


@register("train_val_split", W(
    "SELECT doc_id, line_no, CASE WHEN rk < CAST(floor((SELECT count(*) FROM v_class) * 0.8) AS BIGINT) THEN 'train' "
    "ELSE 'val' END AS split FROM (SELECT doc_id, line_no, row_number() OVER (ORDER BY "
    "md5('0|' || CAST(doc_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR))) - 1 AS rk FROM v_class)"))
def q_split(spark, sf):
    return jobs.split_parts(fx.v_class(spark, sf), ["doc_id", "line_no"], 0.8).select("doc_id", "line_no", "split")


@register("attach_predictions", W(
    "SELECT l.doc_id, l.line_no, l.line_contents, p.pred FROM v_lines l LEFT JOIN v_predictions p "
    "ON l.doc_id = p.doc_id AND l.line_no = p.line_no"))
def q_attach(spark, sf):
    preds = fx.v_predictions(spark, sf).select("doc_id", "line_no", "pred")
    return ln.attach_predictions(fx.v_lines(spark, sf).select("doc_id", "line_no", "line_contents"), preds,
                                 ["doc_id", "line_no"])


@register("evaluate_lines", W(
    f"SELECT {_r6(METRICS)} FROM ({_scores_sql(_cm_sql('ev', 'commented', 'commented_pred'))})",
    *_MODEL_CTES, ("ev", "SELECT c.commented, k.commented_pred FROM v_class c JOIN classified k "
                         "ON c.doc_id = k.doc_id AND c.line_no = k.line_no")))
def q_eval_lines(spark, sf):
    from .recommend_queries import _model
    report, _ = jobs.evaluate_lines(fx.v_class(spark, sf), _model(spark, sf))
    return _round(report, METRICS)


_PARTS_CTE = ("parts", "SELECT *, CASE WHEN rk < CAST(floor(n * 0.6) AS BIGINT) THEN 'train' WHEN rk < CAST(floor(n * 0.6) AS BIGINT) "
                       "+ CAST(floor(n * 0.2) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, line_no, "
                       "count(*) OVER () AS n, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR) || '|' || "
                       "CAST(line_no AS VARCHAR))) - 1 AS rk FROM v_class)")


@register("evaluate_lines_confusion", W(
    "SELECT t, p, n, round(share, 6) AS share FROM ("
    + _cm_sql("ev", "commented", "commented_pred", labels_sql="SELECT unnest([0, 1]) AS l") + ")",
    *_MODEL_CTES, _PARTS_CTE, ("ev", "SELECT c.commented, k.commented_pred FROM v_class c JOIN classified k "
                                     "ON c.doc_id = k.doc_id AND c.line_no = k.line_no JOIN parts s "
                                     "ON c.doc_id = s.doc_id AND c.line_no = s.line_no WHERE s.split = 'test'")))
def q_eval_lines_cm(spark, sf):
    """Row 97 on the test part: the confusion table."""
    from .recommend_queries import _model
    parts = jobs.split_parts(fx.v_class(spark, sf), ["doc_id", "line_no"], 0.6, 0.2, seed=7)
    _, confusion = jobs.evaluate_lines(parts, _model(spark, sf), part="test")
    return _round(confusion, ["share"])


_MC_TOKS = f"SELECT purpose AS label, unnest({S.vocab_tokens('message')}) AS token FROM v_comments WHERE purpose IN ({_PURP_IN})"


@register("train_comments", W(
    "SELECT token, label, CAST(count(*) AS DOUBLE) AS n FROM mc GROUP BY ALL UNION ALL "
    f"SELECT NULL, purpose, CAST(count(*) AS DOUBLE) FROM v_comments WHERE purpose IN ({_PURP_IN}) GROUP BY purpose",
    ("mc", _MC_TOKS)))
def q_train_comments(spark, sf):
    return ln.train_multiclass(fx.v_comments(spark, sf), "message", "purpose", PURP)


# --- the whole label contract: five purposes, twelve subjects (rows 95, 96, 98) -

_TARGETS = ("SELECT conv_id, turn, 'purpose' AS target, purpose AS class FROM v_labelled WHERE purpose IS NOT NULL UNION ALL "
            + " UNION ALL ".join(f"SELECT conv_id, turn, '{s}', CAST(CAST(coalesce({s}, 0.0) AS INTEGER) AS VARCHAR) FROM v_labelled"
                                 for s in SUBJECT_COLUMNS))
_COMMENT_CTES = [
    ("labels_of", "MATERIALIZED: " + _TARGETS),
    ("toks_of", f"MATERIALIZED: SELECT conv_id, turn, token, count(*) AS c FROM (SELECT conv_id, turn, unnest({S.vocab_tokens('message')}) AS token "
                "FROM v_labelled) GROUP BY ALL"),
    ("cmodel", "MATERIALIZED: SELECT target, class, token, CAST(sum(c) AS DOUBLE) AS n FROM labels_of JOIN toks_of USING (conv_id, turn) GROUP BY ALL"),
    ("cprior", "SELECT target, class, CAST(count(*) AS DOUBLE) AS n FROM labels_of GROUP BY ALL"),
]
_CLASSIFY_CTES = [*_COMMENT_CTES,
    ("csize", "SELECT target, CAST(count(DISTINCT token) AS DOUBLE) AS v FROM cmodel GROUP BY target"),
    ("ctotal", "SELECT target, class, sum(n) AS total FROM cmodel GROUP BY ALL"),
    ("cvocab", "SELECT DISTINCT target, token FROM cmodel"),
    ("csum", "SELECT t.conv_id, t.turn, v.target, p.class, sum(t.c * (ln(coalesce(m.n, 0) + 1.0) - ln(o.total + z.v))) AS s "
             "FROM toks_of t JOIN cvocab v USING (token) JOIN cprior p ON p.target = v.target JOIN ctotal o ON o.target = p.target AND "
             "o.class = p.class JOIN csize z ON z.target = v.target LEFT JOIN cmodel m ON m.target = v.target AND m.class = p.class AND "
             "m.token = t.token GROUP BY ALL"),
    ("cscore", "SELECT l.conv_id, l.turn, p.target, p.class, ln(p.n / sum(p.n) OVER (PARTITION BY l.conv_id, l.turn, p.target)) "
               "+ coalesce(s.s, 0.0) AS s FROM v_labelled l JOIN cprior p ON TRUE LEFT JOIN csum s "
               "ON s.conv_id = l.conv_id AND s.turn = l.turn AND s.target = p.target AND s.class = p.class"),
    ("cpred", "MATERIALIZED: SELECT conv_id, turn, "
              "arg_max(class, s) FILTER (WHERE target = 'purpose') AS pred_purpose, "
              + ", ".join(f"CAST(max(s) FILTER (WHERE target = '{s}' AND class = '1') > max(s) FILTER (WHERE target = '{s}' AND class = '0') "
                          f"AS INTEGER) AS pred_{s}" for s in SUBJECT_COLUMNS) + " FROM cscore GROUP BY ALL"),
]
_PREDS = ["pred_" + s for s in SUBJECT_COLUMNS]


def _comment_model(spark, sf):
    return cut_lineage(ln.train_comments(fx.v_labelled(spark, sf), "message", "purpose", PURPOSE_LABELS, SUBJECT_COLUMNS))


@register("train_comment_model", W("SELECT target, class, token, n FROM cmodel UNION ALL SELECT target, class, NULL, n FROM cprior",
                                   *_COMMENT_CTES))
def q_train_comment_model(spark, sf):
    return _comment_model(spark, sf)


@register("train_comment_model_more", W(
    "SELECT target, class, token, 2 * n AS n FROM cmodel UNION ALL SELECT target, class, NULL, 2 * n FROM cprior", *_COMMENT_CTES))
def q_train_more(spark, sf):
    """Row 95 going on from an earlier model: the same comments once more double every count."""
    return ln.train_comments(fx.v_labelled(spark, sf), "message", "purpose", PURPOSE_LABELS, SUBJECT_COLUMNS, base=_comment_model(spark, sf))


@register("classify_comments", W("SELECT conv_id, turn, pred_purpose, " + ", ".join(_PREDS) + " FROM cpred", *_CLASSIFY_CTES))
def q_classify_comments(spark, sf):
    out = ln.classify_comments(fx.v_labelled(spark, sf), "message", _comment_model(spark, sf), PURPOSE_LABELS, SUBJECT_COLUMNS)
    return out.select("conv_id", "turn", "pred_purpose", *_PREDS)


_CEVAL_TALL = ("tall", "SELECT 'purpose' AS target, l.purpose AS t, p.pred_purpose AS p FROM v_labelled l JOIN cpred p USING (conv_id, turn) "
               "UNION ALL " + " UNION ALL ".join(
                   f"SELECT '{s}' AS target, CAST(CAST(coalesce(l.{s}, 0.0) AS INTEGER) AS VARCHAR) AS t, CAST(p.pred_{s} AS VARCHAR) AS p "
                   f"FROM v_labelled l JOIN cpred p USING (conv_id, turn)" for s in SUBJECT_COLUMNS))


@register("evaluate_comments", W(f"SELECT target, {_r6(METRICS)} FROM ({_REPORT_SQL})", *_CLASSIFY_CTES, _CEVAL_TALL))
def q_evaluate_comments(spark, sf):
    report, _, _ = jobs.evaluate_comments(fx.v_labelled(spark, sf), _comment_model(spark, sf), PURPOSE_LABELS, SUBJECT_COLUMNS)
    return _round(report, METRICS)


@register("evaluate_comments_confusion", W(
    "SELECT 'purpose' AS target, t, p, n, round(share, 6) AS share FROM (" + _cm_sql(
        "(SELECT * FROM tall WHERE target = 'purpose')", "t", "p", labels_sql="SELECT unnest([" + ", ".join(f"'{p}'" for p in PURPOSE_LABELS) + "]) AS l")
    + ") UNION ALL SELECT target, t, p, n, round(share, 6) FROM (" + _cm_sql(
        "(SELECT * FROM tall WHERE target <> 'purpose')", "t", "p", "target",
        "SELECT DISTINCT target, unnest(['0', '1']) AS l FROM tall WHERE target <> 'purpose'") + ")", *_CLASSIFY_CTES, _CEVAL_TALL))
def q_evaluate_comments_cm(spark, sf):
    """Row 98: the confusion tables, purpose and subjects under each other."""
    _, purpose, subjects = jobs.evaluate_comments(fx.v_labelled(spark, sf), _comment_model(spark, sf), PURPOSE_LABELS, SUBJECT_COLUMNS)
    both = purpose.select(F.lit("purpose").alias("target"), "t", "p", "n", "share").unionByName(
        subjects.select(F.col("subject").alias("target"), F.col("t").cast("string").alias("t"), F.col("p").cast("string").alias("p"), "n", "share"))
    return _round(both, ["share"])
