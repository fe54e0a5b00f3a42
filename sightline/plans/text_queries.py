"""Queries for the text functions and token statistics (rows 36, 63, 68-74, 88)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import vocab as vb
from ..operators.ordering import explode_rows, posexplode_rows
from ..sources import fixtures as fx
from . import sqltext as S
from .catalog import register

W = fx.with_views


def _explode(df, arr, cols, pos="tok_pos", val="token"):
    return posexplode_rows(df, cols, arr, pos, val)


def _sql_explode(src: str, arr_expr: str, cols: str, pos="tok_pos", val="token") -> str:
    return (f"SELECT {cols}, CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS {pos}, unnest(_a) AS {val} "
            f"FROM (SELECT {cols}, {arr_expr} AS _a FROM {src})")


@register("split_code", W(_sql_explode("v_markup_lines", S.split_code("line_contents"), "doc_id, line_no")))
def q_split_code(spark, sf):
    lines = fx.v_markup_lines(spark, sf)
    return _explode(lines, tx.split_code("line_contents"), ["doc_id", "line_no"])


@register("drop_blank_tokens",
          W(_sql_explode("v_markup_lines", S.drop_blank(S.split_code("line_contents")), "doc_id, line_no")))
def q_drop_blank(spark, sf):
    lines = fx.v_markup_lines(spark, sf)
    return _explode(lines, tx.drop_blank_tokens(tx.split_code("line_contents")), ["doc_id", "line_no"])


def _distinct_words_spark(spark, sf):
    lines = fx.v_markup_lines(spark, sf).unionByName(fx.v_lines(spark, sf))
    return explode_rows(lines, [], tx.split_code("line_contents"), "word").distinct()


_DISTINCT_WORDS_SQL = ("SELECT DISTINCT unnest(" + S.split_code("line_contents") + ") AS word FROM "
                       "(SELECT line_contents FROM v_markup_lines UNION ALL SELECT line_contents FROM v_lines)")


@register("camel_split", W(
    "SELECT word, CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS piece_pos, unnest(_a) AS piece FROM "
    f"(SELECT word, {S.camel_pieces('word')} AS _a FROM words)", ("words", _DISTINCT_WORDS_SQL)))
def q_camel(spark, sf):
    w = _distinct_words_spark(spark, sf)
    return posexplode_rows(w, ["word"], tx.camel_split("word"), "piece_pos", "piece")


@register("underscore_split", W(
    "SELECT word, CAST(generate_subscripts(_a, 1) - 1 AS INTEGER) AS piece_pos, unnest(_a) AS piece FROM "
    f"(SELECT word, {S.prefix_cont(S.underscore_pieces('word'))} AS _a FROM "
    "(SELECT DISTINCT replace(word, 'e', '_') AS word FROM words) WHERE contains(word, '_'))",
    ("words", _DISTINCT_WORDS_SQL)))
def q_underscore(spark, sf):
    w = _distinct_words_spark(spark, sf).select(F.translate("word", "e", "_").alias("word")).distinct()
    w = w.where(F.col("word").contains("_"))
    return posexplode_rows(w, ["word"], tx.underscore_split("word"), "piece_pos", "piece")


@register("number_token", W(
    f"SELECT word, {S.number_token('word')} AS token FROM words", ("words", _DISTINCT_WORDS_SQL)))
def q_number(spark, sf):
    w = _distinct_words_spark(spark, sf)
    return w.select("word", tx.number_token("word").alias("token"))


@register("token_signature", W(
    f"SELECT word, {S.token_signature('word')} AS signature FROM words", ("words", _DISTINCT_WORDS_SQL)))
def q_signature(spark, sf):
    w = _distinct_words_spark(spark, sf)
    return w.select("word", tx.token_signature("word").alias("signature"))


@register("vocab_tokens", W(_sql_explode("v_lines", S.vocab_tokens("line_contents"), "doc_id, line_no")))
def q_vocab_tokens(spark, sf):
    lines = fx.v_lines(spark, sf)
    return _explode(lines, tx.vocab_tokens("line_contents"), ["doc_id", "line_no"])


_TOKENS_SQL = _sql_explode("v_lines", S.vocab_tokens("line_contents"), "doc_id, line_no")
_COUNTS_SQL = ("SELECT token, count(*) AS n, min({'d': doc_id, 'l': line_no, 'p': tok_pos}) AS first_pos "
               "FROM toks GROUP BY token")


@register("token_counts", W("SELECT token, n, first_pos.d AS first_doc, first_pos.l AS first_line, "
                            "first_pos.p AS first_tok FROM counts", ("toks", _TOKENS_SQL), ("counts", _COUNTS_SQL)))
def q_token_counts(spark, sf):
    c = vb.token_counts(fx.v_lines(spark, sf))
    return c.select("token", "n", F.col("first_pos.doc_id").alias("first_doc"),
                    F.col("first_pos.line_no").alias("first_line"), F.col("first_pos.tok_pos").alias("first_tok"))


@register("most_common_tokens", W(
    "SELECT CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS INTEGER) AS rank, token, n FROM counts",
    ("toks", _TOKENS_SQL), ("counts", _COUNTS_SQL)))
def q_most_common(spark, sf):
    return vb.most_common_tokens(fx.v_lines(spark, sf))
