"""Rows 68-74: worked inputs and outputs, and properties of the pieces."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import text as tx


def _collect(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").collect()]


def _check(spark, table, expr):
    assert _collect(spark, list(table), expr) == list(table.values())


def test_split_code(spark):
    _check(spark, {
        "": [], " \t ": [" ", "\t", " "], "x": ["x"], "a&&b": ["a", "&", "&", "b"], "snake_case": ["snake_case"],
        "if (a[i] >= 0x10) { return; }": ["if", " ", "(", "a", "[", "i", "]", " ", ">", "=", " ", "0x10", ")", " ", "{", " ",
                                          "return", ";", " ", "}"],
        "x\u0085y": ["x", "\u0085", "y"], "'q'\\n": ["'", "q", "'", "\\", "n"]}, tx.split_code)


def test_camel(spark):
    _check(spark, {"fooBar": ["foo", "Bar"], "HTTPServerError": ["HTTP", "Server", "Error"], "aBCDe": ["a", "BC", "De"],
                   "ABCd": ["AB", "Cd"], "AbCDe": ["Ab", "C", "De"], "plain": ["plain"], "X": ["X"]}, tx.camel_split)


def test_vocab_tokens(spark):
    _check(spark, {
        "fooBar_baz": ["fooBar", "##_", "##baz"], "HTTPServerError": ["HTTP", "##Server", "##Error"], "42": ["[NUMBER]"],
        "0x1F": ["0x1F"], "_x": ["", "##_", "##x"], "int isNice = 1;": ["int", " ", "is", "##Nice", " ", "=", " ", "[NUMBER]", ";"],
        "": []}, tx.vocab_tokens)


def test_underscore_empty_pieces(spark):
    # Q15: leading, trailing and double underscores give empty and bare ## tokens
    _check(spark, {"_x": ["", "##_", "##x"], "x_": ["x", "##_", "##"], "a__b": ["a", "##_", "##", "##_", "##b"]}, tx.underscore_split)


def test_superscript_is_not_a_number(spark):
    # Q27: only \p{Nd} digits make [NUMBER]
    _check(spark, {"42": "[NUMBER]", "²": "²", "4²": "4²", "٣": "[NUMBER]"}, tx.number_token)


def test_signature(spark):
    _check(spark, {"abcABC12": "aA0", "a1b2c3": "a0", "A_B_C": "A_A", "__": "_", "fooBarFooBar": "aAa", "0_0_0": "0_0",
                   "Aa0Aa0": "Aa0", "x": "a", "": ""}, tx.token_signature)


def test_drop_blank(spark):
    assert _collect(spark, ["a b\tc  d"], lambda c: tx.drop_blank_tokens(tx.split_code(c))) == [["a", "b", "c", "d"]]


@pytest.mark.parametrize("text,want", [
    ("2024-05-06 07:08:09.123456789", "2024-05-06 07:08:09.123456"), ("2024-05-06 07:08:09.123456", "2024-05-06 07:08:09.123456"),
    ("2024-05-06 07:08:09.120", "2024-05-06 07:08:09.12"), ("2024-05-06 07:08:09", "2024-05-06 07:08:09"),
    ("2024-05-06T07:08:09.120+02:00", "2024-05-06 05:08:09.12"), ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"),
    ("2024-05-06T07:08:09", "2024-05-06 07:08:09"), ("2024-05-06 07:08", "2024-05-06 07:08:00"), ("2024-05-06", "2024-05-06 00:00:00"),
    ("6 May 2024", None), (None, None)])
def test_parse_dates(spark, text, want):
    assert _collect(spark, [text], lambda c: tx.parse_dates(c).cast("string")) == [want]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aZ_b .(xY", max_size=12), min_size=1, max_size=8))
def test_vocab_tokens_spell_the_line(spark, texts):
    for text, tokens in zip(texts, _collect(spark, texts, tx.vocab_tokens)):
        assert "".join(t.removeprefix("##") for t in tokens) == text
        for t in tokens:
            bare = t.removeprefix("##")
            assert len(bare) == 1 or not re.search(r"[ .(]", bare)
            assert "_" not in bare or bare == "_"
            # a camel-case point may only stay in a word that had underscores
            assert "_" in text or not re.search("[a-z][A-Z]|[A-Z][A-Z][a-z]", bare)
