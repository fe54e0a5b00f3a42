"""Queries for sources and sinks (rows 1-10, 12, 52, 83, 84).

Each query derives its input files from the test tables with Spark (written under
the session's shared checkpoint folder), then reads them back with the readers.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.text import parse_dates, sanitize_text
from ..operators import metrics as mt
from ..operators.ordering import cpu_partitions, dense_index
from ..schemas import REVIEW_SCHEMA
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources import sinks as sk
from .catalog import register

W = fx.with_views
#: Files of a stand-in change at most (the SQL says the same number).
FILES = 16


def scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "sightline-scratch", f"{name}-{uuid.uuid4().hex[:8]}")


_LINE_COLS = ["change_id", "filename", "doc_id", "line_no", "line_contents"]


@register("read_lines", W("SELECT change_id, filename, doc_id, line_no, line_contents FROM v_lines"))
def q_read_lines(spark, sf):
    path = scratch(spark, "lines")
    lines = fx.v_lines(spark, sf).select(*_LINE_COLS)
    sk.write_table(lines.where(F.col("doc_id") % 2 == 0), path + "/a.csv")
    sk.write_table(lines.where(F.col("doc_id") % 2 == 1), path + "/b.csv")
    schema = "change_id string, filename string, doc_id long, line_no int, line_contents string"
    return rd.read_lines(spark, [path + "/a.csv", path + "/b.csv"], schema=schema).drop("file_seq") \
        .fillna("", subset=["line_contents"])


@register("read_comments", W(
    "SELECT line_contents, message, purpose, code_design, code_style, code_logic, conv_id, turn FROM v_comments"))
def q_read_comments(spark, sf):
    path = scratch(spark, "comments")
    cols = ["line_contents", "message", "purpose", *fx.FIXTURE_SUBJECTS, "conv_id", "turn"]
    sk.write_table(fx.v_comments(spark, sf).select(*cols), path)
    schema = ("line_contents string, message string, purpose string, code_design double, code_style double, "
              "code_logic double, conv_id long, turn long")
    return rd.read_comments(spark, [path], schema=schema).drop("file_seq")


@register("read_corpus", W(
    "SELECT doc_id, line_no - 1 AS line_no, line_contents AS line FROM v_lines"))
def q_read_corpus(spark, sf):
    path = scratch(spark, "corpus")
    # a file's first line tells its document
    docs = fx.table(spark, sf, "documents").select(
        F.concat(F.array(F.col("doc_id").cast("string")), F.split("text", "\n", -1)).alias("lines"))
    docs.select(F.to_json("lines").alias("value")).write.text(path)
    out = rd.read_corpus(spark, path)
    name = out.where("line_no = 0").select("file_no", F.col("line").cast("long").alias("doc_id"))
    return out.where("line_no > 0").join(name, "file_no") \
        .select("doc_id", (F.col("line_no") - 1).cast("bigint").alias("line_no"), "line")


def _one_document(rows, path):
    """Writes rows (order, JSON) as one document ``[a, b, ...]``, in parts that follow each other by name."""
    told = dense_index(rows.where(F.col("j").isNotNull()).select(F.col("o").cast("long").alias("o"), "j"), [F.col("o")], "i")
    n = told.count()
    if not n:
        told, n = rows.sparkSession.createDataFrame([(0, "")], "i long, j string"), 1
    shown = F.concat(F.when(F.col("i") == 0, "[").otherwise(",\n "), F.col("j"), F.when(F.col("i") == n - 1, "]").otherwise(""))
    told.repartitionByRange(cpu_partitions(rows), "i").sortWithinPartitions("i").select(shown.alias("value")) \
        .write.option("lineSep", " ").text(path)


@register("read_corpus_document", W(
    "SELECT doc_id, CAST(line_no - 1 AS BIGINT) AS line_no, line_contents AS line FROM v_lines"))
def q_read_corpus_document(spark, sf):
    """Row 3 in the reference's own form: one JSON document, written in parts and read by many tasks."""
    path = scratch(spark, "corpus-document")
    docs = fx.table(spark, sf, "documents")
    lines = F.concat(F.array(F.col("doc_id").cast("string")), F.split("text", "\n", -1))
    _one_document(docs.select(F.col("doc_id").alias("o"), F.to_json(lines).alias("j")), path)
    out = rd.read_corpus(spark, path, json_lines=False, parts=True)
    name = out.where("line_no = 0").select("file_no", F.col("line").cast("long").alias("doc_id"))
    return out.where("line_no > 0").join(name, "file_no") \
        .select("doc_id", (F.col("line_no") - 1).cast("bigint").alias("line_no"), "line")


def _code_tree(spark, sf):
    """Documents written as a source tree: English and French ones as text files
    (``_d=<lang>_<doc_id>/part-*.txt``), the others as JSON files (``json/*.json``)."""
    path = scratch(spark, "tree")
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    txt = docs.where(F.col("lang").isin("en", "fr"))
    sk.write_tree(txt.withColumn("_d", F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"))), path, "_d", "text")
    docs.where(~F.col("lang").isin("en", "fr")).write.json(path + "/json")
    return path


@register("extract_lines", W(
    "SELECT doc_id, line_no, line_contents AS line FROM v_lines JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')"))
def q_extract_lines(spark, sf):
    path = _code_tree(spark, sf)
    out = rd.extract_lines(spark, path, [".txt"])
    d = F.regexp_extract("filename", r"_d=[a-z]+_(\d+)/", 1).cast("long")
    return out.select(d.alias("doc_id"), "line_no", "line")


@register("file_line_table", W(
    "SELECT lang || '_' || CAST(doc_id AS VARCHAR) AS name, line_no, line_contents "
    "FROM v_lines JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')"))
def q_file_line_table(spark, sf):
    path = _code_tree(spark, sf)
    out = rd.file_line_table(spark, path, [".txt"], name=lambda f: F.regexp_extract(f, r"_d=([^/]+)/", 1))
    return out.withColumnRenamed("filename", "name")


@register("limit_files_tree", W(
    "SELECT doc_id, line_no FROM v_lines WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, lang || '_' || "
    "CAST(doc_id AS VARCHAR) AS d FROM documents WHERE lang IN ('en', 'fr') ORDER BY d LIMIT 50))"))
def q_limit_files_tree(spark, sf):
    path = _code_tree(spark, sf)
    out = rd.extract_lines(spark, path, [".txt"], limit_files=50)
    d = F.regexp_extract("filename", r"_d=[a-z]+_(\d+)/", 1).cast("long")
    return out.select(d.alias("doc_id"), "line_no")


@register("snapshot_commit", W(
    "SELECT arg_max(event_id, (ts, event_id)) AS commit_id, max(ts) AS ts FROM events "
    "WHERE ts < TIMESTAMP '2024-01-15 00:00:00'"))
def q_snapshot_commit(spark, sf):
    commits = fx.table(spark, sf, "events").select(F.col("event_id").alias("commit_id"), "ts")
    return rd.pick_commit(commits, last_commit_before_date="2024-01-15 00:00:00")


def _manifest(spark, sf):
    docs = fx.table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", ".c").otherwise(".txt")
    return docs.select((F.col("doc_id") % 5).alias("commit_id"),
                       F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ext).alias("path"),
                       F.col("text").alias("content"))


@register("snapshot_lines", W(
    "SELECT 'src/' || CAST(doc_id AS VARCHAR) || '.c' AS path, line_no, line_contents AS line FROM v_lines "
    "JOIN documents USING (doc_id) WHERE doc_id % 5 = 3 AND lang = 'en'"))
def q_snapshot_lines(spark, sf):
    chosen = spark.range(1).select(F.lit(3).cast("long").alias("commit_id"))
    return rd.snapshot_lines(_manifest(spark, sf), chosen, [".c"])


def v_reviews(spark, sf):
    """Nested review documents: change = source and 16 doc_ids, revision = language, file = document;
    one comment per file (ranged, single-line or whole-file by doc_id % 3) and one
    diff hunk per line (b, ab, or a+b by line_no % 3)."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    change = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / FILES).cast("string"))

    def hunk(no, line):
        return F.struct(F.when(no % 3 == 2, F.array(F.lit("old"))).alias("a"), F.when(no % 3 != 1, F.array(line)).alias("b"),
                        F.when(no % 3 == 1, F.array(line)).alias("ab"))

    if docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty():
        # a document's hunks are made where it lies, and it travels once, to its change
        dealt = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("change", change).repartition(cpu_partitions(docs), "source", "change")
        told = dealt.select("*", F.transform(F.split("text", "\n", -1), lambda x, i: hunk(i + 1, x)).alias("diff"))
    else:
        lines = fx.v_lines(spark, sf).select("doc_id", "line_no", hunk(F.col("line_no"), F.col("line_contents")).alias("h"))
        diff = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "h"))).alias("_h")) \
            .select("doc_id", F.transform("_h", lambda x: x["h"]).alias("diff"))
        told = docs.join(diff, "doc_id").withColumn("change", change)
    k = F.col("doc_id") % 3
    start = 1 + F.col("doc_id") % 2
    comment = F.struct(
        F.when(k != 2, F.when(k == 0, start).otherwise(1 + F.col("doc_id") % 4)).cast("int").alias("line"),
        F.concat(F.lit("comment on "), F.col("doc_id").cast("string")).alias("message"),
        F.when(k == 0, F.struct(start.cast("int").alias("start_line"),
                                (start + F.col("doc_id") % 3).cast("int").alias("end_line"))).alias("range"))
    files = told.select(
        "source", "change", "lang", F.col("doc_id").cast("string").alias("fname"),
        F.struct(F.col("text").alias("content"), F.array(comment).alias("comments"), "diff").alias("f"))
    revs = files.groupBy("source", "change", "lang").agg(F.map_from_entries(F.collect_list(F.struct("fname", "f"))).alias("files"))
    ch = revs.groupBy("source", "change").agg(F.map_from_entries(F.collect_list(
        F.struct("lang", F.struct(F.col("files").alias("files"))))).alias("revisions"))
    num = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    created = F.concat(F.lit("2024-01-"), F.lpad((num + 1).cast("string"), 2, "0"), F.lit(" 00:00:00"))
    return ch.select(F.col("change").alias("id"), created.alias("created"), "revisions")


def _reviews_json(spark, sf):
    path = scratch(spark, "reviews")
    v_reviews(spark, sf).write.json(path)
    return spark.read.schema(REVIEW_SCHEMA).json(path)


_FLAT_SQL = """
    SELECT d.source || '/' || CAST(d.doc_id // 16 AS VARCHAR) AS change_id, d.lang AS revision_id, CAST(d.doc_id AS VARCHAR) AS filename,
           CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 + d.doc_id % 2 WHEN d.doc_id % 3 = 1 THEN 1 + d.doc_id % 4 END AS INTEGER) AS line,
           CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 + d.doc_id % 2 ELSE 0 END AS INTEGER) AS start_line,
           CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 + d.doc_id % 2 + d.doc_id % 3 ELSE 0 END AS INTEGER) AS end_line,
           l.line_no, l.line_contents, 'comment on ' || CAST(d.doc_id AS VARCHAR) AS message,
           CAST('2024-01-' || lpad(CAST(CAST(regexp_extract(d.source, '(\\d+)', 1) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS TIMESTAMP) AS date
    FROM documents d JOIN v_lines l ON l.doc_id = d.doc_id
    JOIN (SELECT doc_id, max(line_no) AS n FROM v_lines GROUP BY doc_id) m ON m.doc_id = d.doc_id
    WHERE (d.doc_id % 3 = 0 AND l.line_no BETWEEN 1 + d.doc_id % 2 AND least(1 + d.doc_id % 2 + d.doc_id % 3, m.n))
       OR (d.doc_id % 3 = 1 AND l.line_no = 1 + d.doc_id % 4)
       OR (d.doc_id % 3 = 2)"""


@register("flatten_comments", W(_FLAT_SQL))
def q_flatten_comments(spark, sf):
    out = rd.flatten_comments(_reviews_json(spark, sf))
    return out.select("change_id", "revision_id", "filename", "line", "start_line", "end_line",
                      F.col("line_no").cast("bigint").alias("line_no"), "line_contents", "message", "date") \
        .withColumn("line_no", F.col("line_no").cast("int"))


@register("flatten_added_lines", W(
    "SELECT d.source || '/' || CAST(d.doc_id // 16 AS VARCHAR) AS change_id, d.lang AS revision_id, CAST(d.doc_id AS VARCHAR) AS filename, l.line_contents, "
    "CAST('2024-01-' || lpad(CAST(CAST(regexp_extract(d.source, '(\\d+)', 1) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS TIMESTAMP) AS date, "
    "CAST(l.line_no - 1 AS INTEGER) AS hunk_no FROM documents d JOIN v_lines l ON l.doc_id = d.doc_id WHERE l.line_no % 3 = 0"))
def q_flatten_added(spark, sf):
    out = rd.flatten_added_lines(_reviews_json(spark, sf))
    return out.select("change_id", "revision_id", "filename", "line_contents", "date",
                      F.col("hunk_no").cast("int").alias("hunk_no"))


@register("write_table", W(
    "SELECT change_id, filename, CAST(doc_id AS VARCHAR) AS doc_id, CAST(line_no AS VARCHAR) AS line_no, line_contents "
    "FROM v_lines"))
def q_write_table(spark, sf):
    path = scratch(spark, "table")
    sk.write_table(fx.v_lines(spark, sf).select(*_LINE_COLS), path, sep=";")
    return spark.read.option("header", True).option("sep", ";").option("multiLine", True).option("escape", '"').csv(path)


_STORED = "SELECT 'line_' || CAST(vec_id AS VARCHAR) AS line, embedding FROM embeddings"


def _vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", F.concat(F.lit("line_"), F.col("vec_id").cast("string")).alias("line"), "embedding")


@register("embedding_store", _STORED)
def q_embedding_store(spark, sf):
    path = scratch(spark, "emb")
    sk.write_embeddings(_vectors(spark, sf), path)
    return rd.read_embeddings(spark, path)


@register("embedding_store_document", _STORED)
def q_embedding_store_document(spark, sf):
    """Row 12 in the reference's own form: a list of lines and a list of vectors in one JSON document."""
    path = scratch(spark, "emb-document")
    e = _vectors(spark, sf)
    first = e.agg(F.min("vec_id")).first()[0]
    comma = F.when(F.col("vec_id") == first, "[").otherwise(", ")
    halves = [e.select(F.lit(k).alias("k"), F.col("vec_id").alias("o"), F.concat(comma, j).alias("value"))
              for k, j in ((1, F.concat(F.lit('"'), F.col("line"), F.lit('"'))), (3, F.to_json("embedding")))]
    marks = spark.createDataFrame([(0, 0, "["), (2, 0, "], "), (4, 0, "]]")], "k int, o long, value string")
    halves[0].unionByName(halves[1]).unionByName(marks).repartitionByRange(cpu_partitions(e), "k", "o").sortWithinPartitions("k", "o") \
        .select("value").write.option("lineSep", " ").text(path)
    return rd.read_embeddings(spark, path, "json", parts=True)


@register("sanitize_text", W(
    "SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]|;', ' ', 'g') AS text FROM conversations"))
def q_sanitize(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", sanitize_text("text", ";").alias("text"))


@register("parse_dates", W(
    "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS parsed FROM events"))
def q_parse_dates(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", parse_dates(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("parsed"))


@register("corpus_counts", W("SELECT filename, count(*) AS n_lines FROM v_lines GROUP BY filename"))
def q_corpus_counts(spark, sf):
    return mt.corpus_counts(fx.v_lines(spark, sf))


@register("corpus_totals", W("SELECT count(DISTINCT filename) AS n_files, count(*) AS n_lines FROM v_lines"))
def q_corpus_totals(spark, sf):
    return mt.corpus_totals(fx.v_lines(spark, sf))
