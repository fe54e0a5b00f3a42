"""Rows 11, 59-61, 89: pairs are accepted by digests; texts and pieces come to them once."""

import os

from pyspark.sql import functions as F

from sightline.operators import pairs as pr
from sightline.operators import wordpiece as wp
from sightline.plans import jobs
from sightline.session import cut_lineage

FILES = [["A b", "A b", "C 1", "", "C 1", "x y"], ["A b", "C 1"], ["one"], ["", "", "q"]]


def _lines(spark):
    rows = [(i, j + 1, t) for i, f in enumerate(FILES) for j, t in enumerate(f)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, line_contents string").repartition(3)


def _expected(period):
    """Greedy pairs per bucket of global line numbers."""
    out, left, right, g = [], {}, {}, 0
    for i, f in enumerate(FILES):
        for j, t in enumerate(f):
            b = g // period
            if j + 1 < len(f) and t not in left.setdefault(b, set()) and f[j + 1] not in right.setdefault(b, set()):
                left[b].add(t)
                right[b].add(f[j + 1])
                out.append((i, j + 1, t, f[j + 1], g, b))
            g += 1
    return out


def test_texts_come_back_to_the_pairs(spark, tmp_path):
    cols = ["doc_id", "line_no", "left", "right", "gidx", "bucket"]
    got = pr.generate_pairs(_lines(spark), 4)
    assert got.columns == cols
    want = _expected(4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    short = pr.generate_pairs(_lines(spark), 4, texts=False)
    assert {len(r["left"]) for r in short.collect()} == {16}
    told = pr.with_texts(pr.shard_pairs(short, 3), _lines(spark))
    pr.write_shards(told, str(tmp_path / "s"), dealt=True)
    rows = spark.read.parquet(str(tmp_path / "s")).orderBy("pair_seq").collect()
    assert [tuple(r[c] for c in cols) for r in rows] == sorted(want, key=lambda x: x[4])
    assert [r["shard"] for r in rows] == [i // 3 for i in range(len(want))]


def test_lines_that_share_a_place_keep_their_own_pairs(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "c")], "doc_id long, line_no int, line_contents string")
    plain = pr.unique_pairs(pr.consecutive_lines(lines).join(pr.line_buckets(lines), ["doc_id", "line_no"]))
    count = lambda f: sorted(map(tuple, f.select("doc_id", "line_no", "left", "right", "gidx", "bucket").collect()))
    assert count(pr.generate_pairs(lines)) == count(plain)


def test_pieces_of_a_pair_are_those_of_its_lines(spark, monkeypatch):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "A", "C", "on", "##e", " ", "a", "0"])], "token string, token_id long")
    lines = _lines(spark).union(_lines(spark).where("doc_id = 2 OR doc_id = 1"))  # a file that comes twice
    for signatures in (False, True):
        stored = []
        monkeypatch.setattr(jobs, "cut_lineage", lambda df: stored.append(df) or cut_lineage(df))
        show = lambda f: sorted((r["doc_id"], r["line_no"], r["shard"], tuple(r["left_tokens"]), tuple(r["right_tokens"])) for r in f.collect())
        here = show(jobs.line_pairs(lines, vocab, signatures=signatures, period=4, per_shard=2))
        assert not stored and here
        with monkeypatch.context() as m:  # a vocabulary that is too large for every task
            m.setattr(wp, "VOCAB_CHARS", 0)
            assert show(jobs.line_pairs(lines, vocab, signatures=signatures, period=4, per_shard=2)) == here


def test_stored_tables_leave_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    cut_lineage(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before
