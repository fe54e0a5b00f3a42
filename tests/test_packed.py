"""A vocabulary packed in flat arrays: entries, ids and longest matches; lines are cut in place whatever its size."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.functions.text import signature_of, token_signature
from sightline.operators import packed
from sightline.operators import wordpiece as wp
from sightline.sources import fixtures as fx
from test_pairs_wordpiece import longest_matches


@pytest.mark.parametrize("hashed", [1, 1 << 20])
def test_packed_cuts_longest_matches(monkeypatch, hashed):
    monkeypatch.setattr(packed, "HASHED", hashed)
    rnd = random.Random(2)
    for _ in range(200):
        letters = "ab#é漢😀"[:rnd.randint(1, 6)]
        vocab = list({("##" if rnd.random() < 0.6 else "") + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 6)))
                      for _ in range(rnd.randint(0, 12))})
        v = packed.PackedVocabulary(pa.array(vocab, pa.string()), np.arange(len(vocab)))
        words = ["".join(rnd.choice(letters + "z") for _ in range(rnd.randint(0, 15))) for _ in range(8)]
        assert v.pieces(pa.array(words, pa.string())) == [longest_matches(w, set(vocab)) for w in words]
        asked = pa.array(["skipped", *words, None], pa.string()).slice(1)
        assert v.find_ids(asked, -7).tolist() == [vocab.index(w) if w in vocab else -7 for w in [*words, None]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(packed, "_hash", lambda sums, back, start, end: (end - start).astype(np.uint64) << np.uint64(60))
    vocab = ["ab", "cd", "##a", "##b", "", "e"]
    v = packed.PackedVocabulary(pa.array(vocab), np.arange(10, 16))
    assert v.find_ids(pa.array(["cd", "ab", "ba", "", "e", "a"]), -1).tolist() == [11, 10, -1, 14, 15, -1]
    assert v.pieces(pa.array(["cdab", "ae"])) == [["cd", "##a", "##b"], ["a", "##e"]]


def test_a_large_vocabulary_stores_and_shuffles_no_line(spark, monkeypatch):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "the", "walk", "##ing", " ", "0", "Aa", "[NUMBER]", "12"])], "token string, token_id long")
    lines = spark.createDataFrame([(1, 1, "the walking 12 Foo"), (1, 2, ""), (1, 3, None)], "doc_id long, line_no int, line string")
    ids = ["doc_id", "line_no"]

    def results():
        vocab._told = None
        toks = wp.tokenize_lines(lines, ids, "line", vocab)
        return [toks, wp.signature_word_pieces(lines, ids, "line", vocab), wp.vocab_lookup(toks, ids, "tokens", vocab),
                wp.word_pieces(lines, ids, wp.code_words(F.col("line")), vocab)]

    rows = lambda: [sorted(map(tuple, f.collect())) for f in results()]
    small = rows()
    monkeypatch.setattr(wp, "TRIE_CHARS", 0)

    def stored(df):
        raise AssertionError("lines are stored")

    monkeypatch.setattr(wp, "cut_lineage", stored)
    assert rows() == small
    assert all("Exchange" not in f._jdf.queryExecution().toString() for f in results())
    assert small[0][0][2] == ["the", " ", "walk", "##ing", " ", "[NUMBER]", " ", "F", "##o", "##o"]


def test_signature_in_a_worker_is_sparks(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aabBZ019__é\r ßİ-😀") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", token_signature("w").alias("s")).collect()
    assert [r["s"] for r in got] == [signature_of(r["w"]) for r in got]


def test_lines_in_place_are_the_lines(spark, tmp_path):
    docs = spark.createDataFrame([(i, "src", "en", f"a\nb{i}", 1) for i in range(60)], "doc_id long, source string, lang string, text string, n_chars long")
    for name, parts in (("few", 1), ("many", 16)):
        if name == "many":  # a task for each small file
            spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 28))
        docs.repartition(parts).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = fx.v_lines_in_place(spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fx.v_lines(spark, f"{tmp_path}/{name}").collect()))
        assert ("Exchange" in got._jdf.queryExecution().toString()) == (name == "few")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_are_found_in_lines_that_have_digits(spark):
    rows = [(0, "a b"), (1, "12 x1"), (2, "x ١٢"), (3, None), (4, ""), (5, "1a")]
    df = spark.createDataFrame(rows, "i long, line string")
    got = df.select("i", wp.code_words(F.col("line"), False).alias("w"), wp.signature_words(F.col("line"), preserve_whitespace=False).alias("s")).orderBy("i").collect()
    assert [r["w"] for r in got] == [["a", "b"], ["[NUMBER]", "x1"], ["x", "[NUMBER]"], [], [], ["1a"]]
    assert [r["s"] for r in got] == [["a", "b"], ["0", "x1"], ["x", "0"], [], [], ["1a"]]
