"""Stand-in views over the driver's test tables (FIXTURES.md section 2).

Each Spark view has a DuckDB twin in ``VIEW_SQL`` with the same rows, used by
the independent SQL oracle.  Row order is never relied on: every view carries
explicit sequence columns (``doc_id, line_no``; ``conv_id, turn``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import cpu_partitions
from ..schemas import PURPOSE_LABELS, SUBJECT_COLUMNS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Purposes and subjects of the stand-in comments (conversation roles and three
# derived flags).  "tool" never occurs, so a label absent from the data is covered.
FIXTURE_PURPOSES = ["assistant", "system", "tool", "user"]
FIXTURE_SUBJECTS = ["code_design", "code_style", "code_logic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_from(df: DataFrame, id_col: str, text_col: str, rev_col: str | None,
               file_col: str | None = None) -> DataFrame:
    """Split a text column on LF into one row per line (line_no from 1)."""
    rev = F.col(rev_col) if rev_col else F.lit(None).cast("string")
    fname = F.col(file_col) if file_col else F.col(id_col).cast("string")
    return (df.select(F.col(id_col).alias("doc_id"), rev.alias("revision_id"), fname.alias("filename"),
                      F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line_contents"))
            .select(F.concat(F.lit("c"), F.expr("doc_id div 4").cast("string")).alias("change_id"),
                    "revision_id", "filename", "doc_id",
                    (F.col("pos") + 1).cast("int").alias("line_no"),
                    "line_contents"))


def v_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines_from(docs.repartition("doc_id"), "doc_id", "text", "source")


def lie_apart(df: DataFrame) -> bool:
    """Whether the rows of a stored table lie in many tasks as it is: none has over four times its share."""
    own = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    return own[0] >= 2 * df.sparkSession.sparkContext.defaultParallelism and own[1] * own[0] <= 4 * own[2]


def v_lines_in_place(spark, sf_dir) -> DataFrame:
    """``v_lines`` for steps that take lines as they come: documents are dealt only where the table's row groups leave
    them in few tasks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    if not lie_apart(table(spark, sf_dir, "documents").select("doc_id")):
        docs = docs.repartition(cpu_partitions(docs), "doc_id")
    return lines_from(docs, "doc_id", "text", "source")


def v_markup_lines(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return lines_from(pages.repartition("page_id"), "page_id", "html", None, "url")


def _commented_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select("doc_id")


def v_commented(spark, sf_dir) -> DataFrame:
    return v_lines(spark, sf_dir).join(_commented_docs(spark, sf_dir), "doc_id", "left_semi")


def v_ok(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("is_commented_doc"))
    return (v_lines(spark, sf_dir).join(labels, "doc_id")
            .where(~F.col("is_commented_doc") | (F.col("line_no") % 4 == 0))
            .drop("is_commented_doc"))


def v_class(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).cast("int").alias("commented"))
    return v_lines(spark, sf_dir).join(labels, "doc_id")


def md5_bucket(col, buckets: int = 100):
    """Deterministic hash bucket shared with the oracle (md5, first 8 hex digits)."""
    return (F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long") % buckets)


def v_predictions(spark, sf_dir) -> DataFrame:
    c = v_class(spark, sf_dir)
    return c.withColumn("pred", F.when(md5_bucket(F.col("doc_id")) < 20, 1 - F.col("commented"))
                        .otherwise(F.col("commented")).cast("int"))


def v_reference(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 5 != 0).select(
        F.col("vec_id").alias("ref_id"),
        F.concat(F.lit("line_"), F.col("vec_id").cast("string")).alias("line"),
        "embedding")


def v_queries(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 5 == 0).select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("line_"), F.col("vec_id").cast("string")).alias("query_line"),
        "embedding")


def v_comments(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    n_vec = table(spark, sf_dir, "embeddings").count()  # one scalar
    c = conv.withColumn("n_vec", F.lit(n_vec))
    return c.select(
        "conv_id", "turn",
        F.concat(F.lit("line_"), ((F.col("conv_id") * 31 + F.col("turn")) % F.col("n_vec")).cast("string"))
        .alias("line_contents"),
        F.col("text").alias("message"),
        F.col("role").alias("purpose"),
        (F.col("turn") % 2).cast("double").alias("code_design"),
        F.when(F.length("text") % 3 == 0, 1.0).otherwise(0.0).alias("code_style"),
        F.when(F.col("conv_id") % 5 == 4, F.lit(None).cast("double"))
        .when(F.col("conv_id") % 5 < 2, 1.0).otherwise(0.0).alias("code_logic"),
    )


def v_labelled(spark, sf_dir) -> DataFrame:
    """The comments with the whole label contract: five purposes (one in six null), twelve subjects (some null)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    kind = (F.length("message") + F.col("turn")) % (len(PURPOSE_LABELS) + 1)
    flags = [F.when((F.col("conv_id") + i) % 11 == 0, F.lit(None).cast("double"))
             .when((F.col("conv_id") * (i + 3) + F.col("turn") * 7 + F.length("message")) % 5 == 0, 1.0).otherwise(0.0).alias(s)
             for i, s in enumerate(SUBJECT_COLUMNS)]
    purpose = F.try_element_at(F.array(*[F.lit(p) for p in PURPOSE_LABELS]), (kind + 1).cast("int"))
    return c.select("*", purpose.alias("purpose"), *flags)


def v_comment_preds(spark, sf_dir) -> DataFrame:
    """Stand-in predictions for the comments: purpose right for 70 % of the rows
    (else 'assistant'), each subject flag flipped for 15 %."""
    c = v_comments(spark, sf_dir)
    b1 = md5_bucket(F.col("conv_id") * 100 + F.col("turn"))
    b2 = md5_bucket(F.col("conv_id") * 100 + F.col("turn") + 7)
    out = c.withColumn("pred_purpose", F.when(b1 < 70, F.col("purpose")).otherwise(F.lit("assistant")))
    for s in FIXTURE_SUBJECTS:
        v = F.coalesce(F.col(s), F.lit(0.0))
        out = out.withColumn("pred_" + s, F.when(b2 < 15, 1.0 - v).otherwise(v))
    return out


# ---------------------------------------------------------------------------
# DuckDB twins (used only by the SQL oracle)
# ---------------------------------------------------------------------------

VIEW_SQL = {
    "v_lines": """
        SELECT 'c' || CAST(doc_id // 4 AS VARCHAR) AS change_id, source AS revision_id,
               CAST(doc_id AS VARCHAR) AS filename, doc_id, CAST(line_no AS INTEGER) AS line_no,
               line_contents
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line_contents,
                     generate_subscripts(string_split(text, chr(10)), 1) AS line_no
              FROM documents)""",
    "v_markup_lines": """
        SELECT 'c' || CAST(page_id // 4 AS VARCHAR) AS change_id, CAST(NULL AS VARCHAR) AS revision_id,
               url AS filename, page_id AS doc_id, CAST(line_no AS INTEGER) AS line_no, line_contents
        FROM (SELECT page_id, url, unnest(string_split(html, chr(10))) AS line_contents,
                     generate_subscripts(string_split(html, chr(10)), 1) AS line_no
              FROM pages)""",
    "v_commented": """
        SELECT * FROM v_lines WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)""",
    "v_ok": """
        SELECT l.* FROM v_lines l JOIN labels b ON l.doc_id = b.doc_id
        WHERE NOT (b.quality = 0 OR b.toxic = 1) OR l.line_no % 4 = 0""",
    "v_class": """
        SELECT l.*, CAST(1 - b.quality AS INTEGER) AS commented FROM v_lines l JOIN labels b ON l.doc_id = b.doc_id""",
    "v_predictions": """
        SELECT *, CAST(CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20
                            THEN 1 - commented ELSE commented END AS INTEGER) AS pred
        FROM v_class""",
    "v_reference": """
        SELECT vec_id AS ref_id, 'line_' || CAST(vec_id AS VARCHAR) AS line, embedding
        FROM embeddings WHERE vec_id % 5 <> 0""",
    "v_queries": """
        SELECT vec_id AS query_id, 'line_' || CAST(vec_id AS VARCHAR) AS query_line, embedding
        FROM embeddings WHERE vec_id % 5 = 0""",
    "v_comments": """
        SELECT conv_id, turn,
               'line_' || CAST((conv_id * 31 + turn) % (SELECT count(*) FROM embeddings) AS VARCHAR) AS line_contents,
               text AS message, role AS purpose,
               CAST(turn % 2 AS DOUBLE) AS code_design,
               CASE WHEN length(text) % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS code_style,
               CASE WHEN conv_id % 5 = 4 THEN NULL WHEN conv_id % 5 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS code_logic
        FROM conversations""",
    "v_labelled": "SELECT conv_id, turn, text AS message, ["
                  + ", ".join(f"'{p}'" for p in PURPOSE_LABELS)
                  + f"][CAST((length(text) + turn) % {len(PURPOSE_LABELS) + 1} AS INTEGER) + 1] AS purpose, "
                  + ", ".join(f"CASE WHEN (conv_id + {i}) % 11 = 0 THEN NULL WHEN (conv_id * {i + 3} + turn * 7 + length(text)) % 5 = 0 "
                              f"THEN 1.0 ELSE 0.0 END::DOUBLE AS {s}" for i, s in enumerate(SUBJECT_COLUMNS))
                  + " FROM conversations",
    "v_comment_preds": """
        SELECT *, CASE WHEN ('0x' || substr(md5(CAST(conv_id * 100 + turn AS VARCHAR)), 1, 8))::BIGINT % 100 < 70
                       THEN purpose ELSE 'assistant' END AS pred_purpose,
               CASE WHEN ('0x' || substr(md5(CAST(conv_id * 100 + turn + 7 AS VARCHAR)), 1, 8))::BIGINT % 100 < 15
                    THEN 1.0 - coalesce(code_design, 0.0) ELSE coalesce(code_design, 0.0) END::DOUBLE AS pred_code_design,
               CASE WHEN ('0x' || substr(md5(CAST(conv_id * 100 + turn + 7 AS VARCHAR)), 1, 8))::BIGINT % 100 < 15
                    THEN 1.0 - coalesce(code_style, 0.0) ELSE coalesce(code_style, 0.0) END::DOUBLE AS pred_code_style,
               CASE WHEN ('0x' || substr(md5(CAST(conv_id * 100 + turn + 7 AS VARCHAR)), 1, 8))::BIGINT % 100 < 15
                    THEN 1.0 - coalesce(code_logic, 0.0) ELSE coalesce(code_logic, 0.0) END::DOUBLE AS pred_code_logic
        FROM v_comments""",
}


def with_views(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """Prefix an oracle query with the fixture views (and extra named CTEs)."""
    def cte(name, sql):
        sql = sql.strip()
        if sql.startswith("MATERIALIZED:"):  # computed once (e.g. inside a recursive walk)
            return f"{name} AS MATERIALIZED ({sql[len('MATERIALIZED:'):].strip()})"
        return f"{name} AS ({sql})"
    parts = [cte(name, sql) for name, sql in VIEW_SQL.items()]
    parts += [cte(name, sql) for name, sql in extra]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()
