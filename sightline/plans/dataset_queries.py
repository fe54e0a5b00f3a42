"""Queries for the training-set rows (14-25, 37-40, 54-58, 66, 67, 90)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..sources import fixtures as fx
from . import sqltext as S
from .catalog import register

W = fx.with_views
SEQ = ["doc_id", "line_no"]
KEEP = ["change_id", "revision_id", "filename", "doc_id", "line_no", "line_contents"]
KEEP_SQL = ", ".join(KEEP)


@register("project_columns", W("SELECT change_id, filename, line_no, line_contents FROM v_lines"))
def q_project(spark, sf):
    return ds.project_columns(fx.v_lines(spark, sf), ["change_id", "filename", "line_no", "line_contents"])


@register("fill_text", W(
    "SELECT change_id, coalesce(revision_id, '') AS revision_id, filename, doc_id, line_no, line_contents "
    "FROM (SELECT * FROM v_lines UNION ALL SELECT * FROM v_markup_lines)"))
def q_fill_text(spark, sf):
    both = ds.union_inputs(fx.v_lines(spark, sf), fx.v_markup_lines(spark, sf))
    return ds.fill_text(both, ["revision_id"])


@register("fill_subjects", W(
    "SELECT conv_id, turn, coalesce(code_design, 0.0) AS code_design, coalesce(code_style, 0.0) AS code_style, "
    "coalesce(code_logic, 0.0) AS code_logic FROM v_comments"))
def q_fill_subjects(spark, sf):
    c = fx.v_comments(spark, sf).select("conv_id", "turn", *fx.FIXTURE_SUBJECTS)
    return ds.fill_subjects(c, fx.FIXTURE_SUBJECTS)


@register("drop_empty_lines", W("SELECT doc_id, line_no, line_contents FROM v_markup_lines WHERE line_contents <> ''"))
def q_drop_empty(spark, sf):
    return ds.drop_empty_lines(fx.v_markup_lines(spark, sf)).select("doc_id", "line_no", "line_contents")


@register("filter_purposes", W(
    "SELECT conv_id, turn, purpose FROM v_comments WHERE purpose IN ('assistant', 'user')"))
def q_filter_purposes(spark, sf):
    return ds.filter_purposes(fx.v_comments(spark, sf), ["assistant", "user"]).select("conv_id", "turn", "purpose")


@register("filter_dates", W(
    "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"))
def q_filter_dates(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "ts")
    return ds.filter_dates(ev, "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@register("filter_files", W(
    "SELECT doc_id, line_no, filename FROM v_markup_lines "
    "WHERE regexp_extract(filename, '(\\.[^./]+)$', 1) IN ('.html', '.htm') AND NOT contains(filename, 'COMMIT')"))
def q_filter_files(spark, sf):
    return ds.filter_files(fx.v_markup_lines(spark, sf), "filename", [".html", ".htm"]) \
        .select("doc_id", "line_no", "filename")


@register("limit_files", W(
    "SELECT doc_id, line_no FROM v_lines WHERE filename IN "
    "(SELECT DISTINCT filename FROM v_lines ORDER BY filename LIMIT 100)"))
def q_limit_files(spark, sf):
    return ds.limit_files(fx.v_lines(spark, sf), "filename", 100).select("doc_id", "line_no")


@register("decide", W(
    f"SELECT doc_id, line_no, score, CAST(score >= 0.5 AS INTEGER) AS line_decision, "
    f"CAST(score > 0.5 AS INTEGER) AS subject_decision FROM "
    f"(SELECT doc_id, line_no, {S.md5_bucket('doc_id * 1000 + line_no')} / 100.0 AS score FROM v_lines)"))
def q_decide(spark, sf):
    from ..operators.learn import decide
    lines = fx.v_lines(spark, sf)
    s = lines.select("doc_id", "line_no",
                     (fx.md5_bucket(F.col("doc_id") * 1000 + F.col("line_no")) / 100.0).alias("score"))
    return s.select("doc_id", "line_no", "score", decide("score", 0.5, strict=False).alias("line_decision"),
                    decide("score", 0.5, strict=True).alias("subject_decision"))


@register("lines_in_reviewed_changes", W(
    "SELECT doc_id, line_no FROM v_ok WHERE change_id IN (SELECT change_id FROM v_commented)"))
def q_reviewed(spark, sf):
    return ds.lines_in_reviewed_changes(fx.v_ok(spark, sf), fx.v_commented(spark, sf)).select("doc_id", "line_no")


@register("ok_lines", W(
    "SELECT doc_id, line_no FROM v_ok o WHERE NOT EXISTS (SELECT 1 FROM v_commented c "
    "WHERE c.change_id = o.change_id AND c.line_contents = o.line_contents)"))
def q_ok_lines(spark, sf):
    return ds.ok_lines(fx.v_ok(spark, sf), fx.v_commented(spark, sf)).select("doc_id", "line_no")


@register("change_cogroup", W(
    "SELECT coalesce(c.change_id, n.change_id) AS change_id, coalesce(c.n_commented, 0) AS n_commented, "
    "coalesce(n.n_lines, 0) AS n_lines FROM "
    "(SELECT change_id, count(*) AS n_commented FROM v_commented GROUP BY change_id) c FULL JOIN "
    "(SELECT change_id, count(*) AS n_lines FROM v_ok GROUP BY change_id) n ON c.change_id = n.change_id"))
def q_cogroup(spark, sf):
    return ds.change_cogroup(fx.v_ok(spark, sf), fx.v_commented(spark, sf))


_CAPPED = ("capped", """
    SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY doc_id, line_no) AS _rn
                     FROM v_commented) c
    LEFT JOIN (SELECT change_id, count(*) AS m FROM v_ok GROUP BY change_id) m ON c.change_id = m.change_id
    WHERE c._rn <= coalesce(m.m, 0)""")


@register("cap_commented", W("SELECT doc_id, line_no FROM capped", _CAPPED))
def q_cap(spark, sf):
    return ds.cap_commented(fx.v_commented(spark, sf), fx.v_ok(spark, sf), SEQ).select("doc_id", "line_no")


@register("dedup_commented", W(
    "SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY change_id, line_contents "
    "ORDER BY doc_id, line_no) AS rn FROM v_commented) WHERE rn = 1"))
def q_dedup(spark, sf):
    return ds.dedup_commented(fx.v_commented(spark, sf), SEQ).select("doc_id", "line_no")


def prepare_sql(ratio=1.0, balance=True, carry=True, uniqueness=None, body=None) -> str:
    """The reference's loop stated in SQL: a recursive CTE walks the changes in order."""
    capped = ("SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY doc_id, line_no) AS _rn "
              "FROM cm) c LEFT JOIN (SELECT change_id, count(*) AS m FROM ln GROUP BY change_id) m "
              "ON c.change_id = m.change_id WHERE c._rn <= coalesce(m.m, 0)") if balance else "SELECT * FROM cm"
    ctes = [
        ("cm", "SELECT * FROM v_commented WHERE coalesce(line_contents, '') <> ''"),
        ("ln", "SELECT * FROM v_ok WHERE coalesce(line_contents, '') <> '' "
               "AND change_id IN (SELECT change_id FROM v_commented WHERE coalesce(line_contents, '') <> '')"),
        ("ord", "SELECT change_id, row_number() OVER (ORDER BY f) - 1 AS change_rank FROM "
                "(SELECT change_id, min({'d': doc_id, 'l': line_no}) AS f FROM cm GROUP BY change_id)"),
        ("capped_", capped),
        ("kept0", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_id, line_contents "
                  "ORDER BY doc_id, line_no) AS _rn2 FROM capped_) WHERE _rn2 = 1"),
        ("elig0", "SELECT * FROM ln o WHERE NOT EXISTS (SELECT 1 FROM cm c WHERE c.change_id = o.change_id "
                  "AND c.line_contents = o.line_contents)"),
    ]
    if uniqueness is None:
        ctes += [("kept", "SELECT * FROM kept0"), ("elig", "SELECT * FROM elig0")]
    else:
        both = ("(SELECT line_contents FROM kept0 INTERSECT SELECT line_contents FROM elig0)")
        k_src = "kept0" if uniqueness == 1 else f"(SELECT * FROM kept0 WHERE line_contents NOT IN {both})"
        e_src = "elig0" if uniqueness == 0 else f"(SELECT * FROM elig0 WHERE line_contents NOT IN {both})"
        ctes += [("kept", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_contents ORDER BY doc_id, "
                          f"line_no) AS _u FROM {k_src}) WHERE _u = 1"),
                 ("elig", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_contents ORDER BY doc_id, "
                          f"line_no) AS _u FROM {e_src}) WHERE _u = 1")]
    ctes += [
        ("cnt", f"SELECT o.change_rank, o.change_id, coalesce(k.c, 0) AS c, coalesce(e.a, 0) AS a, "
                f"CAST(ceil(coalesce(k.c, 0) * {float(ratio)}) AS BIGINT) AS r FROM ord o "
                f"LEFT JOIN (SELECT change_id, count(*) AS c FROM kept GROUP BY change_id) k ON o.change_id = k.change_id "
                f"LEFT JOIN (SELECT change_id, count(*) AS a FROM elig GROUP BY change_id) e ON o.change_id = e.change_id"),
    ]
    if carry:
        ctes += [("steps", "SELECT CAST(-1 AS BIGINT) AS change_rank, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS t "
                           "UNION ALL SELECT q.change_rank, s.d + least(q.a, greatest(q.r, q.c - s.d, 0)) - q.c, "
                           "least(q.a, greatest(q.r, q.c - s.d, 0)) FROM steps s JOIN cnt q "
                           "ON q.change_rank = s.change_rank + 1"),
                 ("take", "SELECT q.change_id, q.c, q.a, s.t FROM cnt q JOIN steps s ON q.change_rank = s.change_rank")]
    else:
        ctes += [("take", "SELECT change_id, c, a, least(a, r) AS t FROM cnt")]
    ctes += [("chosen", "SELECT e.* FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY doc_id, line_no) "
                        "AS _q FROM elig) e JOIN take t ON e.change_id = t.change_id WHERE e._q <= t.t"),
             ("dataset", f"SELECT {KEEP_SQL}, 1 AS commented FROM kept UNION ALL "
                         f"SELECT {KEEP_SQL}, 0 AS commented FROM chosen")]
    return W(body or "SELECT * FROM dataset", *ctes, recursive=carry)


def _prepare(spark, sf, **kw):
    return ds.prepare_dataset(fx.v_commented(spark, sf), fx.v_ok(spark, sf), SEQ, KEEP, **kw)


def _take(spark, sf, ratio, carry):
    cm, ln = fx.v_commented(spark, sf), fx.v_ok(spark, sf)
    ln = ds.lines_in_reviewed_changes(ln, cm)
    kept = ds.dedup_commented(ds.cap_commented(cm, ln, SEQ), SEQ)
    elig = ds.ok_lines(ln, cm)
    c = kept.groupBy("change_id").agg(F.count(F.lit(1)).alias("c"))
    a = elig.groupBy("change_id").agg(F.count(F.lit(1)).alias("a"))
    counts = ds.change_order(cm, SEQ).join(c, "change_id", "left").join(a, "change_id", "left") \
        .fillna(0, subset=["c", "a"])
    return ds.quota_take(counts, ratio, carry).select("change_id", "c", "a", "t")


@register("quota_ok", prepare_sql(ratio=0.5, carry=False, body="SELECT change_id, c, a, t FROM take"))
def q_quota(spark, sf):
    return _take(spark, sf, 0.5, False)


@register("quota_ok_carry", prepare_sql(ratio=1.0, carry=True, body="SELECT change_id, c, a, t FROM take"))
def q_quota_carry(spark, sf):
    return _take(spark, sf, 1.0, True)


@register("quota_ok_carry_ratio2", prepare_sql(ratio=2.0, carry=True, body="SELECT change_id, c, a, t FROM take"))
def q_quota_carry2(spark, sf):
    return _take(spark, sf, 2.0, True)


@register("force_uniqueness", prepare_sql(uniqueness=1))
def q_force_unique(spark, sf):
    return _prepare(spark, sf, force_uniqueness_for_class=1)


@register("force_uniqueness_ok", prepare_sql(uniqueness=0))
def q_force_unique0(spark, sf):
    return _prepare(spark, sf, force_uniqueness_for_class=0)


@register("prepare_dataset", prepare_sql())
def q_prepare(spark, sf):
    return _prepare(spark, sf)


@register("prepare_dataset_strict_half", prepare_sql(ratio=0.5, carry=False, balance=False))
def q_prepare_half(spark, sf):
    return _prepare(spark, sf, ok_to_commented_ratio=0.5, allow_taking_more_non_commented_lines_from_change=False,
                    balance_commented_lines_for_change=False)


@register("class_distribution", W("SELECT commented, count(*) AS n FROM v_class GROUP BY commented"))
def q_class_dist(spark, sf):
    return ds.class_distribution(fx.v_class(spark, sf), "commented")


@register("dataset_summary", prepare_sql(body=(
    "SELECT count(*) AS n_rows, count(DISTINCT line_contents) AS n_distinct_lines, "
    "CAST(sum(CASE WHEN commented = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_class_0, "
    "CAST(sum(CASE WHEN commented = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_class_1 FROM dataset")))
def q_summary(spark, sf):
    return ds.dataset_summary(_prepare(spark, sf))


@register("ambiguous_lines", W(
    "SELECT CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous, "
    "CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share_ambiguous FROM "
    "(SELECT line_contents, count(DISTINCT commented) AS k, count(*) AS n FROM v_class GROUP BY line_contents)"))
def q_ambiguous(spark, sf):
    return ds.ambiguous_lines(fx.v_class(spark, sf))


@register("distinct_lines", W(
    "SELECT line_contents, f.d AS first_doc_id, f.l AS first_line_no FROM "
    "(SELECT line_contents, min({'d': doc_id, 'l': line_no}) AS f FROM v_lines GROUP BY line_contents)"))
def q_distinct(spark, sf):
    return ds.distinct_lines(fx.v_lines(spark, sf), SEQ)


@register("union_inputs", W(
    "SELECT change_id, doc_id, line_no, line_contents FROM v_commented UNION ALL "
    "SELECT change_id, doc_id, line_no, line_contents FROM v_ok"))
def q_union(spark, sf):
    cols = ["change_id", "doc_id", "line_no", "line_contents"]
    return ds.union_inputs(fx.v_commented(spark, sf).select(*cols), fx.v_ok(spark, sf).select(*cols))


@register("lines_in_both_classes", W(
    "SELECT line_contents FROM v_class WHERE commented = 0 INTERSECT SELECT line_contents FROM v_class WHERE commented = 1"))
def q_both(spark, sf):
    return ds.lines_in_both_classes(fx.v_class(spark, sf))
