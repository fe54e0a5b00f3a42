"""Rows 4, 5, 22 on a tree that the driver does not list: tasks find and read its files."""

import pytest

from sightline.sources import readers as rd

FILES = {"a.txt": b"x\ny\n", "d=1/p.txt": b"1\r\n2", "d=1/q.c": b"c\n", "deep/er/z.txt": b"\xff\xc3\xa9\n", "deep/b.txt": b"", "_hidden/n.txt": b"n\n",
         "_k=v/k.txt": b"k\n", ".dot.txt": b"n\n", "deep/_x.txt": b"n\n", "plain": b"p\n", "sp ace/e%20.txt": b"e\n", "w.json": b"{}\n"}


@pytest.mark.parametrize("extensions, limit", [([".txt"], None), ([".txt", ".c"], 3), ([""], None), ([".t*"], None)])
def test_tasks_find_what_sparks_source_finds(spark, tmp_path, monkeypatch, extensions, limit):
    for name, held in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(held)
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        rows = lambda: sorted(map(tuple, rd.extract_lines(spark, path, extensions, limit).collect()))
        with monkeypatch.context() as m:
            want = rows()
            m.setattr(rd, "LISTED", 3)
            assert rows() == want
            assert rd.extract_lines(spark, path, extensions, limit).inputFiles() != [f"file://{tmp_path}/a.txt"]
            assert "binaryFile" not in rd.extract_lines(spark, path, extensions, limit)._jdf.queryExecution().toString()
    if extensions == [".txt"]:
        assert {r[1] for r in want} == {"a.txt", "d=1/p.txt", "deep/er/z.txt", "_k=v/k.txt", "sp ace/e%20.txt"}


def test_names_that_are_no_folder_are_left_to_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "LISTED", 0)
    (tmp_path / "a.txt").write_text("x\n")
    got = rd.extract_lines(spark, f"{tmp_path}/*.txt", [".txt"])
    assert [r["line"] for r in got.collect()] == ["x"]
