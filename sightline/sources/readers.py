"""Readers (rows 1-9, 12, 13, 22) and review-history flattening.

Files are read by Spark's own sources with explicit schemas; row order is never
relied on: ``file_seq`` (position of the file in the given path list) and line
numbers carry the order.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import file_suffix
from ..operators.ordering import cpu_partitions
from ..session import cut_lineage
from .json_document import read_lines_and_vectors, read_lists_of_strings
from .sinks import _reachable as reachable

# Stands for U+FFFD of a source file while undecodable bytes are dropped (private-use characters).
_OWN_MARK = "\uE000\uF8FF\uE000"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _plain(path: str) -> str:
    """A path without scheme and final slash."""
    return re.sub(_SCHEME, "/", path).rstrip("/")


def _file_seq(paths: list[str]) -> F.Column:
    """Position of the row's file in ``paths`` (path order = stacking order): of the file itself, or of the folder
    that holds it, by whole paths; the first position of a path that is named twice."""
    place: dict[str, int] = {}
    for i, p in enumerate(paths):
        place.setdefault(_plain(p), i)
    at = F.create_map(*[x for p, i in place.items() for x in (F.lit(p), F.lit(i))])
    f = F.regexp_replace(F.input_file_name(), _SCHEME, "/")
    return F.coalesce(at[f], at[F.regexp_replace(f, "/[^/]*$", "")]).cast("int")


def read_table(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None,
               cols: list[str] | None = None, sep: str = ";", fmt: str = "csv") -> DataFrame:
    """Rows 1/2: read delimited (or Parquet) files, keep ``cols`` (default: all), add
    ``file_seq``; CSV is quoted and only the empty field is null (Q29 fixed)."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"') \
            .option("multiLine", True).option("nullValue", "").option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
        df = r.csv(paths)
    else:
        df = spark.read.schema(schema).parquet(*paths) if schema is not None else spark.read.parquet(*paths)
    df = df.withColumn("file_seq", _file_seq(paths))
    return df.select(*(cols or [c for c in df.columns if c != "file_seq"]), "file_seq")


def read_lines(spark, paths, cols=None, sep=";", schema=None, fmt="csv") -> DataFrame:
    """Row 1."""
    return read_table(spark, paths, schema, cols, sep, fmt)


def read_comments(spark, paths, cols=None, sep=";", schema=None, fmt="csv") -> DataFrame:
    """Row 2."""
    return read_table(spark, paths, schema, cols, sep, fmt)


def read_corpus(spark: SparkSession, path: str, json_lines: bool = True, parts: bool = False) -> DataFrame:
    """Row 3: corpus of files (lists of lines) -> ``file_no, line_no, line``.

    ``json_lines``: one JSON array (a file's lines) per text line.  Otherwise the
    reference's single JSON document (a list of lists); with ``parts`` the files of the folder ``path``, in order of
    their names, are one document.  All are split across tasks."""
    if json_lines:
        raw = spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id())
        files = raw.select(F.col("_seq").alias("file_no"), F.from_json("value", "array<string>").alias("lines"))
        return files.select("file_no", F.posexplode("lines").alias("line_no", "line"))
    return read_lists_of_strings(spark, path, parts)


#: Files of a tree that the driver lists itself; of a larger one it holds no file's name.
LISTED = 50_000
#: Names of one batch, and bytes of one batch of contents.
_NAMES, _BYTES = 10_000, 1 << 24


def _left_out(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")) \
        and not name.startswith(("_common_metadata", "_metadata"))


def _entries(store, path: str) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a folder, of what a folder holds; of a local one as it is read."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from ((f"{path}/{e.name}", e.is_dir()) for e in found if not _left_out(e.name))
    else:
        yield from ((i.path, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(path)) if not _left_out(i.base_name))


def _below(store, path: str) -> Iterator[str]:
    """All files below a folder, one level after the other."""
    todo = [path]
    while todo:
        for p, folder in _entries(store, todo.pop()):
            if folder:
                todo.append(p)
            else:
                yield p


def _ends(path: str, extensions: list[str] | None) -> bool:
    return extensions is None or path.endswith(tuple(extensions))


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= _NAMES or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _listed_by_tasks(spark: SparkSession, code_path: str, extensions: list[str] | None, limit: int) -> DataFrame | None:
    """``path`` of the files of a tree with these suffixes: one task lists the tree's first level, many the folders there.
    None for a tree of at most ``limit`` files and folders, for what is no folder, and where pyarrow does not open it."""
    uri = reachable(code_path)
    if uri is None or re.search(r"[*?\[\]{}]", code_path):
        return None
    store, root = fs.FileSystem.from_uri(uri)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return None

    def first(batches):
        own, base = fs.FileSystem.from_uri(uri)
        for _ in batches:
            yield from _batched(_entries(own, base), ["path", "folder"], [pa.string(), pa.bool_()])

    def small(batches):
        own, base = fs.FileSystem.from_uri(uri)
        n = 0
        for b in batches:
            todo = [base] * b.num_rows
            while todo and n <= limit:
                for p, folder in _entries(own, todo.pop()):
                    n += 1
                    if folder:
                        todo.append(p)
                    if n > limit:
                        break
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    one = spark.range(0, 1, 1, 1)
    if one.mapInArrow(small, "n long").agg(F.max("n")).first()[0] <= limit:
        return None
    level = cut_lineage(one.mapInArrow(first, "path string, folder boolean"))

    def deeper(batches):
        own, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            found = (p for at, folder in zip(*(c.to_pylist() for c in b.columns)) for p in (_below(own, at) if folder else (at,)))
            yield from _batched(((p,) for p in found if _ends(p, extensions)), ["path"], [pa.string()])

    return level.repartition(4 * cpu_partitions(level), "path").mapInArrow(deeper, "path string")


def _read_by_tasks(files: DataFrame, code_path: str) -> DataFrame:
    """``path`` (as Spark's file sources name it) and ``content`` of listed files."""
    uri = reachable(code_path)
    store, _ = fs.FileSystem.from_uri(uri)
    mark = "file:" if isinstance(store, fs.LocalFileSystem) else re.match(r"[A-Za-z][\w+.-]*://[^/]*", uri)[0]

    def read(batches):
        own, _ = fs.FileSystem.from_uri(uri)

        def rows():
            for b in batches:
                for p in b.column(0).to_pylist():
                    with own.open_input_stream(p, compression=None) as f:
                        yield mark + p, f.read()

        yield from _batched(rows(), ["path", "content"], [pa.string(), pa.binary()])

    return files.mapInArrow(read, "path string, content binary")


def extract_lines(spark: SparkSession, code_path: str, file_extensions: list[str],
                  limit_files: int | None = None) -> DataFrame:
    """Rows 4/5/22: recursive listing by suffix (by tasks, for a tree of over ``LISTED`` files and
    folders that pyarrow opens; by Spark's binary source else), optional first-n files (path
    order), UTF-8 decoding with undecodable bytes dropped, one row per line:
    ``path, filename`` (relative to ``code_path``), ``line_no`` (from 1), ``line``."""
    plain_ends = all(re.fullmatch(r"\.[\w.+-]+", e) for e in file_extensions)  # other files are not even opened
    told = _listed_by_tasks(spark, code_path, list(file_extensions) if plain_ends else None, LISTED)
    if told is not None:
        told = told.where(file_suffix("path").isin(list(file_extensions)))
        if limit_files is not None:
            told = told.orderBy("path").limit(limit_files)
        else:
            told = told.repartition(4 * cpu_partitions(told), "path")
        files = _read_by_tasks(told, code_path)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if plain_ends:
            files = files.option("pathGlobFilter", "*{" + ",".join(file_extensions) + "}")
        files = files.load(code_path).select("path", "content")
        files = files.where(file_suffix("path").isin(list(file_extensions)))
        if limit_files is not None:
            first = files.select("path").orderBy("path").limit(limit_files)
            files = files.join(first, "path", "left_semi")
    # undecodable bytes dropped; universal newlines; lines as readlines() gives them
    # (no empty line after a final newline, none at all for an empty file)
    text = F.col("content").cast("string")
    text = F.replace(text, F.lit("\uFFFD"), F.lit(_OWN_MARK))  # marks of the text itself are kept
    text = F.replace(F.replace(F.make_valid_utf8(text), F.lit("\uFFFD"), F.lit("")), F.lit(_OWN_MARK), F.lit("\uFFFD"))
    text = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))
    base = _plain(code_path) + "/"
    plain = F.regexp_replace("path", _SCHEME, "/")
    rel = F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)
    out = files.select("path", rel.alias("filename"),
                       F.posexplode(lines).alias("pos", "line"))
    return out.select("path", "filename", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def pick_commit(commits: DataFrame, commit: str | None = None, last_commit: bool = False,
                last_commit_before_date: str | None = None, id_col: str = "commit_id", ts_col: str = "ts") -> DataFrame:
    """Row 6: the named commit, the newest, or the newest strictly before a date
    (ties on time: the larger id)."""
    if commit is not None:
        return commits.where(F.col(id_col) == commit).select(id_col, ts_col)
    c = commits
    if last_commit_before_date is not None:
        c = c.where(F.col(ts_col) < F.lit(last_commit_before_date).cast("timestamp"))
    return c.agg(F.max_by(F.col(id_col), F.struct(ts_col, id_col)).alias(id_col),
                 F.max(ts_col).alias(ts_col))


def snapshot_lines(manifest: DataFrame, chosen: DataFrame, file_extensions: list[str],
                   commit_col: str = "commit_id") -> DataFrame:
    """Row 7: all lines of the files with the given suffixes in the chosen snapshot:
    ``path, line_no, line``."""
    files = manifest.join(chosen.select(commit_col), commit_col, "left_semi") \
        .where(file_suffix("path").isin(list(file_extensions)))
    out = files.select("path", F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "line"))
    return out.select("path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def read_vocab(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Row 13: a vocabulary table (Parquet ``token, token_id``), first ``limit`` ids."""
    v = spark.read.parquet(path)
    return v if limit is None else v.where(F.col("token_id") < limit)


def read_embeddings(spark: SparkSession, path: str, fmt: str = "parquet", parts: bool = False) -> DataFrame:
    """Row 12: ``line, embedding``.  ``fmt='json'`` reads the reference's
    ``[lines, vectors]`` documents (aligned by position; ``parts`` as in ``read_corpus``), split across tasks."""
    return spark.read.parquet(path) if fmt == "parquet" else read_lines_and_vectors(spark, path, parts)


def file_line_table(spark: SparkSession, code_path: str, file_extensions: list[str], limit_files: int | None = None,
                    name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Row 5: ``filename, line_no, line_contents`` of a source tree, line ends taken off; ``name`` turns the relative
    path into the file's name."""
    lines = extract_lines(spark, code_path, file_extensions, limit_files)
    shown = name(F.col("filename")) if name is not None else F.col("filename")
    return lines.select(shown.alias("filename"), "line_no", F.regexp_replace("line", "[\r\n]", "").alias("line_contents"))


# --- review history (rows 8, 9) ---------------------------------------------

def _files(reviews: DataFrame) -> DataFrame:
    rev = reviews.select(F.col("id").alias("change_id"), F.col("created").alias("date_str"),
                         F.explode("revisions").alias("revision_id", "rev"))
    return rev.select("change_id", "date_str", "revision_id", F.explode("rev.files").alias("filename", "f"))


def flatten_comments(reviews: DataFrame, end_exclusive: bool = False, sep: str | None = None) -> DataFrame:
    """Row 8: one row per commented line.  Three cases: a ranged comment (lines
    start..end, Q2 fixed: end included; ``end_exclusive=True`` reproduces the
    reference), a single-line comment (that line; Q3 fixed: the last line counts),
    a whole-file comment (every line of that file; Q4 fixed)."""
    from ..functions.text import parse_dates, sanitize_text
    f = _files(reviews)
    c = f.select("change_id", "date_str", "revision_id", "filename", F.split("f.content", "\n", -1).alias("lines"),
                 F.posexplode("f.comments").alias("comment_no", "cm"))
    n = F.size("lines")
    start = F.col("cm.range.start_line")
    end = F.coalesce(F.nullif(F.col("cm.range.end_line"), F.lit(0)), n)
    ranged = F.col("cm.line").isNotNull() & start.isNotNull() & (start != 0)
    lo = F.when(ranged, start).when(F.col("cm.line").isNotNull(), F.col("cm.line")).otherwise(F.lit(1))
    hi = F.when(ranged, end - (1 if end_exclusive else 0)).when(F.col("cm.line").isNotNull(), F.col("cm.line")) \
        .otherwise(n)
    hi = F.least(hi, n)
    rows = c.select("*", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))
                    .alias("line_idx"))
    text = F.element_at(F.col("lines"), F.col("line_idx"))
    out = rows.select(
        "change_id", parse_dates(F.col("date_str")).alias("date"), "revision_id", "filename",
        F.col("cm.line").alias("line"), F.coalesce(start, F.lit(0)).alias("start_line"),
        F.coalesce(F.col("cm.range.end_line"), F.lit(0)).alias("end_line"), "comment_no",
        F.col("line_idx").alias("line_no"), text.alias("line_contents"), F.col("cm.message").alias("message"))
    if sep is not None:
        out = out.withColumn("line_contents", sanitize_text("line_contents", sep)) \
            .withColumn("message", sanitize_text("message", sep))
    return out


def flatten_added_lines(reviews: DataFrame, include_replaced: bool = False, skip_name: str | None = "COMMIT",
                        sep: str | None = None) -> DataFrame:
    """Row 9: one row per added line: lines of ``b`` hunks.  Q7 kept: by default only
    pure additions (hunks without ``a``); ``include_replaced`` adds replaced lines.
    Q8 kept: files whose name contains ``skip_name`` are skipped."""
    from ..functions.text import parse_dates, sanitize_text
    f = _files(reviews)
    if skip_name:
        f = f.where(~F.col("filename").contains(skip_name))
    h = f.select("change_id", "date_str", "revision_id", "filename", F.posexplode("f.diff").alias("hunk_no", "h"))
    if not include_replaced:
        h = h.where(F.col("h.a").isNull())
    rows = h.select("*", F.posexplode("h.b").alias("pos", "line_contents"))
    out = rows.select("change_id", parse_dates(F.col("date_str")).alias("date"), "revision_id", "filename",
                      "hunk_no", "pos", "line_contents")
    if sep is not None:
        out = out.withColumn("line_contents", sanitize_text("line_contents", sep))
    return out
