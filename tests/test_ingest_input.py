"""Row 103: the stream's input is made without joins, stored packed, and what is stored in between goes."""

import os

from sightline.plans import io_queries as io
from sightline.plans import stream_queries as sq

SCHEMA = "doc_id long, source string, lang string, text string, n_chars long"
DOCS = [(i, f"src{i % 3}", "en" if i % 2 else "de", "\n".join(f"l{j}" for j in range(i)), 1) for i in range(1, 9)]


def _reviews(spark, path, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = io.v_reviews(spark, str(path))
    files = {(r["id"], lang, name): f for r in got.collect() for lang, rev in r["revisions"].items() for name, f in rev["files"].items()}
    return got, {k: (f["content"], [(h["a"], h["b"], h["ab"]) for h in f["diff"]]) for k, f in files.items()}


def test_hunks_are_made_where_documents_lie(spark, tmp_path):
    got, rows = _reviews(spark, tmp_path / "one", [*DOCS, (None, "src1", "en", "x", 1), (90, "src1", "en", None, 1)])
    assert "Join" not in got._jdf.queryExecution().toString()
    hunk = lambda no, t: (["old"] if no % 3 == 2 else None, [t] if no % 3 != 1 else None, [t] if no % 3 == 1 else None)
    assert rows == {(f"{s}/{d // 16}", lang, str(d)): (t, [hunk(j + 1, x) for j, x in enumerate(t.split("\n"))]) for d, s, lang, t, _ in DOCS}
    # a document number that comes again, in another revision: both have all hunks of that number
    _, again = _reviews(spark, tmp_path / "two", [*DOCS, (4, "src2", "fr", "other", 1)])
    assert {k: v for k, v in again.items() if k[2] != "4"} == {k: v for k, v in rows.items() if k[2] != "4"}
    assert [len(v[1]) for k, v in again.items() if k[2] == "4"] == [5, 5]


def test_the_streams_input_is_packed(spark, monkeypatch):
    folders, gone = [], []
    monkeypatch.setattr(io, "scratch", lambda s, name, make=io.scratch: folders.append(make(s, name)) or folders[-1])
    monkeypatch.setattr(sq, "release", lambda *t: gone.extend(t))
    assert sq.q_ingest_stream(spark, "/root/testdata/sf0.001").count() > 0
    names = [f for d, _, n in os.walk(folders[0].removeprefix("file:")) for f in n if f.startswith("part-") and "/bad" not in d]
    assert names and all(f.endswith(".json.gz") for f in names)
    assert len(gone) == 1
