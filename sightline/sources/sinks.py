"""Sinks (rows 10, 11, 12)."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import cpu_partitions
from ..session import shuffles_go

#: How Spark names the folder of a null or empty value, and what it escapes in a folder's name.
_NO_VALUE, _ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_table(df: DataFrame, path: str, sep: str = ";", fmt: str = "csv", mode: str = "overwrite") -> None:
    """Row 10: delimited output with a header (quoted, so separators inside text are
    safe), or Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"') \
            .option("quoteAll", False).csv(path)
    else:
        w.format(fmt).save(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Row 12: ``line, embedding`` as Parquet."""
    df.select("line", "embedding").write.mode(mode).parquet(path)


def _reachable(path: str) -> str | None:
    """``path`` as a URI that pyarrow opens, if it can."""
    uri = re.sub("^file:/+", "file:///", path)
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return uri


def _tree_writer(uri: str, folder_col: str):
    """Rows (folder, text) in order of their folders: a file for each folder, under its own name once it is whole."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(uri)
        now, out, at, part, n = None, None, "", "", 0

        def done():
            out.close()
            store.move(part, f"{at}/part-00000.txt")

        for b in batches:
            for folder, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                if out is None or folder != now:
                    if out is not None:
                        done()
                    now, n = folder, n + 1
                    at = f"{root}/{folder_col}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', folder) if folder else _NO_VALUE}"
                    part = f"{at}/.{uuid.uuid4().hex}"
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(part, compression=None)
                if text.is_valid:
                    out.write(text.as_buffer())
                out.write(b"\n")
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    return run


def write_tree(df: DataFrame, path: str, folder_col: str, text_col: str) -> int | None:
    """A tree with a folder ``<folder_col>=<value>`` for every value, which holds its texts in one text file, each with a
    line end after it: what ``partitionBy`` writes, without the cost of Spark's writer per folder.  Tasks write the files
    where they stay; a repeated task writes the same ones again.  A file system that pyarrow does not open is left to
    Spark's writer.  Returns the number of folders, if tasks wrote them."""
    rows = df.select(F.col(folder_col).cast("string").alias(folder_col), F.col(text_col).cast("string").alias(text_col))
    rows = rows.repartition(cpu_partitions(df), folder_col).sortWithinPartitions(folder_col, text_col)
    uri = _reachable(path)
    if uri is None:
        rows.write.partitionBy(folder_col).text(path)
        return None
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    with shuffles_go(df.sparkSession):
        return rows.mapInArrow(_tree_writer(uri, folder_col), "n long").agg(F.sum("n")).first()[0]
