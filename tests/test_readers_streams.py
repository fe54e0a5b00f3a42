"""Readers on awkward files and paths; the ingest stream with revisions, bad records and a restart."""

import json
import random
import time

import pytest

from sightline.sources import readers as rd
from sightline.streaming import streams as st


def test_source_tree_with_bad_bytes(spark, tmp_path):
    root = tmp_path / "a+b(c).d"
    (root / "x").mkdir(parents=True)
    (root / "x" / "one.c").write_bytes(b"ok\xff line\r\nreplaced \xef\xbf\xbd stays\n\xc3x")
    (root / "two.c").write_bytes(b"")
    (root / "no.txt").write_bytes(b"not read")
    got = sorted((r["filename"], r["line_no"], r["line"]) for r in rd.extract_lines(spark, str(root), [".c"]).collect())
    assert got == [("x/one.c", 1, "ok line"), ("x/one.c", 2, "replaced � stays"), ("x/one.c", 3, "x")]
    assert rd.extract_lines(spark, str(root), [".c"], limit_files=1).select("path").distinct().count() <= 1


def test_file_seq_with_prefix_paths(spark, tmp_path):
    for name in ("x", "x2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(f"a;b\n{name};1\n")
    (tmp_path / "x3.csv").write_text("a;b\nx3;1\n")
    paths = [str(tmp_path / p) for p in ("x2", "x", "x3.csv")]
    got = {r["a"]: r["file_seq"] for r in rd.read_lines(spark, paths, schema="a string, b string").collect()}
    assert got == {"x2": 0, "x": 1, "x3": 2}
    got = {r["a"]: r["file_seq"] for r in rd.read_lines(spark, ["file://" + p for p in paths], schema="a string, b string").collect()}
    assert got == {"x2": 0, "x": 1, "x3": 2}


def test_corpus_both_formats(spark, tmp_path):
    files = [["a", "b"], [], ["c"]]
    (tmp_path / "one.json").write_text(json.dumps(files))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, files)))
    for path, flag in (("one.json", False), ("lines.json", True)):
        rows = rd.read_corpus(spark, str(tmp_path / path), json_lines=flag).orderBy("file_no", "line_no").collect()
        assert [(r["line_no"], r["line"]) for r in rows] == [(0, "a"), (1, "b"), (0, "c")]


def test_embedding_store_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([["l1", "l2"], [[1.0, 2.0], [3.0, 4.5]]]))
    got = {r["line"]: r["embedding"] for r in rd.read_embeddings(spark, str(tmp_path / "e.json"), "json").collect()}
    assert got == {"l1": [1.0, 2.0], "l2": [3.0, 4.5]}


def test_one_document_read_by_many_tasks(spark, tmp_path):
    """Brackets, commas, quotes and escapes inside strings, empty lists, nulls, long strings; blocks of a few bytes."""
    rnd = random.Random(5)
    odd = ['a, "b"', "[1, 2]", "\\\\", '\\"', "], [", "é\u2028漢", "", " ", "tab\there", ",,,", '"', "x" * 300, None, "null", "end\\"]
    files = [[rnd.choice(odd) for _ in range(rnd.choice([0, 0, 1, 3, 12]))] for _ in range(60)]
    want = sorted((f, i, x) for f, lines in enumerate(files) for i, x in enumerate(lines) if x is not None)
    for i, (indent, size) in enumerate(((None, 64), (4, 200), (None, 1 << 27))):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(files, indent=indent, ensure_ascii=bool(i % 2)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            got = rd.read_corpus(spark, str(path), json_lines=False)
            assert size > 1000 or spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 8
            rows = got.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["file_no"], r["line_no"], r["line"]) for r in rows if r["line"] is not None) == want
        assert len(rows) == sum(map(len, files))
    lines, vectors = [x or "" for x in odd], [[rnd.random() for _ in range(5)] for _ in odd]
    (tmp_path / "v.json").write_text(json.dumps([lines, vectors], indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = rd.read_embeddings(spark, str(tmp_path / "v.json"), "json").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], [round(x, 5) for x in r["embedding"]]) for r in got) == sorted((x, [round(y, 5) for y in v]) for x, v in zip(lines, vectors))


def _review(change, created, revisions):
    return json.dumps({"id": change, "created": created, "revisions": {
        r: {"files": {"f.c": {"content": "l1\nl2", "comments": [{"line": 1, "message": f"{change}-{r}"}], "diff": [{"b": ["l2"]}]}}}
        for r in revisions}})


def test_ingest_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def land(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(rows))

    def run():
        for q in st.ingest_stream(spark, src, out, ck):
            q.awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(out + "/comments").collect())
    land("1.json", _review("c1", "2024-01-01 00:00:00", ["r1"]), _review(None, "2024-01-01 00:00:00", ["r1"]), "{broken",
         _review("c2", "someday", ["r1"]))
    assert run() == ["c1-r1"]
    # a restart with the same change again, one revision more
    land("2.json", _review("c1", "2024-01-01 00:00:00", ["r1", "r2"]), _review("c3", "2024-02-01 00:00:00", ["r1"]))
    assert run() == ["c1-r1", "c1-r2", "c3-r1"]
    assert run() == ["c1-r1", "c1-r2", "c3-r1"]
    bad = spark.read.parquet(out + "/bad").collect()
    assert len(bad) == 3 and {r["id"] for r in bad if r["_corrupt"] is None} == {None, "c2"}


def test_ingest_state_is_per_change(spark, tmp_path):
    """A late revision comes in once whatever its date; repeats over batches and inside one do not."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def land(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(rows))

    def run():
        for q in st.ingest_stream(spark, src, out, ck, max_files_per_trigger=1):
            assert q.awaitTermination(60)
        return sorted(r["message"] for r in spark.read.parquet(out + "/comments").collect())
    land("1.json", _review("c1", "2024-06-01 00:00:00", ["r2"]), _review("c1", "2024-06-01 00:00:00", ["r2"]))
    land("2.json", _review("c1", "2024-06-01 00:00:00", ["r2"]))
    assert run() == ["c1-r2"]
    land("3.json", _review("c1", "1999-01-01 00:00:00", ["r1"]), _review("c2", "2024-06-01 00:00:00", ["r1"]))
    assert run() == ["c1-r1", "c1-r2", "c2-r1"]
    with pytest.raises(ValueError):
        st.ingest_stream(spark, src, out, ck, forget_after=1)


def test_ingest_forgets_by_timer(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def messages():
        try:
            return sorted(r["message"] for r in spark.read.parquet(out + "/comments").collect())
        except Exception:  # nothing written so far
            return []

    def until(want):
        end = time.time() + 45
        while messages() != want and time.time() < end:
            time.sleep(0.5)
        assert messages() == want
    (tmp_path / "in" / "1.json").write_text(_review("c1", "2024-06-01 00:00:00", ["r1"]))
    queries = st.ingest_stream(spark, src, out, ck, forget_after=2, available_now=False)
    try:
        until(["c1-r1"])
        time.sleep(4)  # the timer fires in a batch without input
        (tmp_path / "in" / "2.json").write_text(_review("c1", "2024-06-01 00:00:00", ["r1"]))
        until(["c1-r1", "c1-r1"])
    finally:
        for q in queries:
            q.stop()


def test_ingest_query_writes_few_files(spark, tmp_path):
    """The stream's input is files of some size, not one for every partition of the reviews."""
    from pathlib import Path
    from sightline.plans.stream_queries import q_ingest_stream
    from sightline.session import checkpoint_dir
    docs = [(i, f"one {i}\ntwo\nthree", "en", f"src{i % 20}", 10) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(checkpoint_dir(spark).removeprefix("file:")) / "sightline-scratch"
    before = set(folder.glob("in-*"))
    rows = q_ingest_stream(spark, str(tmp_path)).collect()
    assert len({(r["change_id"], r["filename"], r["line_no"]) for r in rows}) == len(rows) > 60
    own, = set(folder.glob("in-*")) - before
    assert all(len(list((own / part).glob("part-*"))) == 1 for part in ("part1", "part2", "again"))


def test_one_document_in_parts(spark, tmp_path):
    """A document cut into files at any place but after a comma or a backslash."""
    rnd = random.Random(7)
    odd = ['a, "b"', "[1, 2]", "\\\\", '\\"', "], [", "é漢", "", " ", ",,,", '"', "x" * 90, "null", "end\\"]
    files = [[rnd.choice(odd) for _ in range(rnd.choice([0, 1, 3, 12]))] for _ in range(40)]
    lines, vectors = odd, [[rnd.randrange(64) / 8 for _ in range(5)] for _ in odd]
    for name, held in (("c", files), ("v", [lines, vectors])):
        raw = json.dumps(held, ensure_ascii=False)
        cuts = sorted({0, len(raw), *(i for i in rnd.sample(range(1, len(raw)), 60) if raw[i - 1] not in ",\\")})
        (tmp_path / name).mkdir()
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / name / f"part-{i:05d}.txt").write_text(raw[a:z])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = rd.read_corpus(spark, str(tmp_path / "c"), json_lines=False, parts=True).collect()
        emb = rd.read_embeddings(spark, str(tmp_path / "v"), "json", parts=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((f, i, x) for f, own in enumerate(files) for i, x in enumerate(own))
    assert sorted((r["line"], r["embedding"]) for r in emb) == sorted((x, v) for x, v in zip(lines, vectors))


def test_one_document_is_written_by_many_tasks(spark, tmp_path):
    from sightline.plans.io_queries import _one_document
    rows = [(i // 2, json.dumps([str(i // 2), "x, y"])) for i in range(400)]  # every order comes twice
    _one_document(spark.createDataFrame(rows + [(7, None)], "o long, j string"), str(tmp_path / "d"))
    names = sorted(f.name for f in (tmp_path / "d").glob("part-*"))
    assert len(names) > 1
    whole = "".join((tmp_path / "d" / f).read_text() for f in names)
    assert json.loads(whole) == [json.loads(j) for _, j in rows]
    _one_document(spark.createDataFrame([], "o long, j string"), str(tmp_path / "e"))
    assert rd.read_corpus(spark, str(tmp_path / "e"), json_lines=False, parts=True).collect() == []
