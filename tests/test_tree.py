"""Rows 4, 5, 22 on a tree with a folder per value: written by tasks, read back by suffix."""

import os

import pytest
from pyspark.sql import functions as F

from sightline.plans import io_queries as io
from sightline.sources import readers as rd
from sightline.sources import sinks as sk

ROWS = [("en_1", "a\nb"), ("en_2", ""), ("fr:3 /x", "é\r\nc"), ("en_2", "again"), (None, "none"), ("de_4", None)]


def _held(path):
    return {os.path.basename(d): open(f"{d}/{f}", newline="").read() for d, _, names in os.walk(path)
            for f in names if f.endswith(".txt")}


def test_tree_is_the_one_that_sparks_writer_makes(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, "d string, t string")
    assert sk.write_tree(df, f"file:{tmp_path}/own", "d", "t") == 5
    with monkeypatch.context() as m:  # a file system that pyarrow does not open
        m.setattr(sk, "_reachable", lambda path: None)
        assert sk.write_tree(df, f"file:{tmp_path}/spark", "d", "t") is None
    own = _held(tmp_path / "own")
    assert own == _held(tmp_path / "spark") and own["d=en_2"] == "\nagain\n" and len(own) == 5
    got = rd.extract_lines(spark, f"file:{tmp_path}/own", [".txt"]).where("filename LIKE 'd=en_1/%'")
    assert sorted((r["line_no"], r["line"]) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_code_tree_is_not_left_to_the_committer(spark, monkeypatch):
    """Spark's writer commits a folder per document one by one."""
    seen = []
    write = sk.write_tree
    monkeypatch.setattr(sk, "write_tree", lambda *a: seen.append(write(*a)))
    io._code_tree(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert seen == [docs.where(F.col("lang").isin("en", "fr")).select("doc_id").distinct().count()]


@pytest.mark.parametrize("extensions, want", [([".txt"], {"a.txt"}), ([".txt", ".c++"], {"a.txt", "c.c++"}), ([""], {"plain"}), ([".t*"], set())])
def test_other_files_are_not_opened(spark, tmp_path, extensions, want):
    for name in ("a.txt", "b.json", "c.c++", "plain"):
        (tmp_path / name).write_text("x\n")
    got = rd.extract_lines(spark, str(tmp_path), extensions)
    assert {r["filename"] for r in got.collect()} == want
    if extensions == [".txt"]:
        assert [os.path.basename(f) for f in got.inputFiles()] == ["a.txt"]
