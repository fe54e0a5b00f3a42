"""Queries for vocabulary and word-piece rows (13, 30, 75-78, 88, 105)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import drop_blank_tokens, vocab_tokens
from ..operators import vocab as vb
from ..operators import wordpiece as wp
from ..operators.ordering import posexplode_rows
from ..schemas import BASE_TOKENS
from ..sources import fixtures as fx
from . import sqltext as S
from ..session import cut_lineage
from .catalog import register
from .text_queries import _COUNTS_SQL, _TOKENS_SQL

W = fx.with_views
IDS = ["doc_id", "line_no"]
MIN_COUNT = 5
SEQ_LEN = 128
PAIR_LEN = 64

_BASE = " UNION ALL ".join(f"SELECT {S.q(t)} AS token, CAST({i} AS BIGINT) AS token_id" for i, t in enumerate(BASE_TOKENS))
_VOCAB_CTES = [
    ("toks", _TOKENS_SQL), ("counts", _COUNTS_SQL),
    ("base", _BASE),
    ("vocab", f"SELECT b.token, b.token_id, coalesce(c.n, 0) AS n FROM base b LEFT JOIN counts c ON b.token = c.token "
              f"UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, first_pos) - 1 + {len(BASE_TOKENS)} AS token_id, n "
              f"FROM counts WHERE token <> '' AND n >= {MIN_COUNT} AND token NOT IN (SELECT token FROM base)"),
]


def sql_code_words(line: str, preserve_whitespace: bool = True) -> str:
    w = S.split_code(f"coalesce({line}, '')")
    if not preserve_whitespace:
        w = S.drop_blank(w)
    return f"list_transform({w}, lambda t: {S.number_token('t')})"


def _walk_ctes(words_sql: str, tag: str = ""):
    return [
        (f"lmax{tag}", "SELECT max(length(regexp_replace(token, '^##', ''))) AS m FROM vocab"),
        (f"words{tag}", f"MATERIALIZED: SELECT DISTINCT word FROM ({words_sql}) WHERE length(word) > 0 AND word <> '[NUMBER]'"),
        (f"cand{tag}", f"SELECT word, s, l FROM words{tag}, range(0, length(word)) r(s), "
                       f"range(1, least((SELECT m FROM lmax{tag}), length(word) - s) + 1) r2(l)"),
        (f"best{tag}", f"MATERIALIZED: SELECT c.word, c.s, max(c.l) AS l FROM cand{tag} c JOIN vocab v ON v.token = "
                       f"(CASE WHEN c.s > 0 THEN '##' ELSE '' END) || substr(c.word, c.s + 1, c.l) GROUP BY ALL"),
        (f"walk{tag}", f"SELECT word, 0 AS p, -1 AS k, CAST(NULL AS VARCHAR) AS piece FROM words{tag} UNION ALL "
                       f"SELECT w.word, w.p + coalesce(b.l, 1), w.k + 1, (CASE WHEN w.p > 0 THEN '##' ELSE '' END) || "
                       f"substr(w.word, w.p + 1, coalesce(b.l, 1)) FROM walk{tag} w LEFT JOIN best{tag} b "
                       f"ON b.word = w.word AND b.s = w.p WHERE w.p < length(w.word)"),
        (f"pieces{tag}", f"SELECT word, k AS piece_pos, piece FROM walk{tag} WHERE k >= 0 UNION ALL "
                         f"SELECT '[NUMBER]', 0, '[NUMBER]'"),
    ]


_LINE_WORDS = (f"SELECT doc_id, line_no, CAST(generate_subscripts(_w, 1) - 1 AS INTEGER) AS word_pos, unnest(_w) AS word "
               f"FROM (SELECT doc_id, line_no, {sql_code_words('line_contents')} AS _w FROM v_lines)")
_WP_CTES = _VOCAB_CTES + [("lw", _LINE_WORDS)] + _walk_ctes("SELECT word FROM lw") + [
    ("wp", "SELECT l.doc_id, l.line_no, l.word_pos, CAST(p.piece_pos AS INTEGER) AS piece_pos, p.piece AS token "
           "FROM lw l JOIN pieces p ON l.word = p.word"),
    ("wp_lines", "SELECT l.doc_id, l.line_no, coalesce(t.tokens, []) AS tokens FROM v_lines l LEFT JOIN "
                 "(SELECT doc_id, line_no, list(token ORDER BY word_pos, piece_pos) AS tokens FROM wp GROUP BY ALL) t "
                 "ON l.doc_id = t.doc_id AND l.line_no = t.line_no"),
    ("unk", "SELECT token_id FROM vocab WHERE token = '[UNK]'"),
    ("ids", "SELECT l.doc_id, l.line_no, coalesce(t.token_ids, []) AS token_ids FROM v_lines l LEFT JOIN "
            "(SELECT w.doc_id, w.line_no, list(CAST(coalesce(v.token_id, (SELECT token_id FROM unk)) AS INTEGER) "
            "ORDER BY w.word_pos, w.piece_pos) AS token_ids FROM wp w LEFT JOIN vocab v ON v.token = w.token GROUP BY ALL) t "
            "ON l.doc_id = t.doc_id AND l.line_no = t.line_no"),
]


def _vocab(spark, sf):
    # the vocabulary is an artifact used by every tokenizing step: materialized once
    return cut_lineage(vb.build_vocab(fx.v_lines_in_place(spark, sf), min_count=MIN_COUNT, dealt=True))


@register("build_vocab", W("SELECT token, token_id, n FROM vocab", *_VOCAB_CTES))
def q_build_vocab(spark, sf):
    return _vocab(spark, sf)


@register("load_vocab", W("SELECT token, token_id FROM vocab WHERE token_id < 1000", *_VOCAB_CTES))
def q_load_vocab(spark, sf):
    return vb.load_vocab(_vocab(spark, sf), 1000).select("token", "token_id")


def _wp_rows(spark, sf):
    lines = fx.v_lines_in_place(spark, sf)
    rows = wp.word_pieces(lines, IDS, wp.code_words(F.col("line_contents")), _vocab(spark, sf))
    return rows.select(*IDS, F.col("pos._wp").cast("int").alias("word_pos"), F.col("pos._pp").cast("int")
                       .alias("piece_pos"), "token")


@register("word_piece", W("SELECT doc_id, line_no, word_pos, piece_pos, token FROM wp", *_WP_CTES, recursive=True))
def q_word_piece(spark, sf):
    return _wp_rows(spark, sf)


def _ids(spark, sf):
    vocab = _vocab(spark, sf)
    toks = wp.tokenize_lines(fx.v_lines_in_place(spark, sf), IDS, "line_contents", vocab)
    return wp.vocab_lookup(toks, IDS, "tokens", vocab), vocab


@register("vocab_lookup", W("SELECT doc_id, line_no, array_to_string(token_ids, ' ') AS token_ids FROM ids",
                            *_WP_CTES, recursive=True))
def q_vocab_lookup(spark, sf):
    ids, _ = _ids(spark, sf)
    return ids.select(*IDS, F.array_join("token_ids", " ").alias("token_ids"))


@register("encode_line", W(
    f"SELECT doc_id, line_no, array_to_string(list_concat(e, list_transform(range(greatest({SEQ_LEN} - len(e), 0)), "
    f"lambda x: 0)), ' ') AS token_ids, array_to_string(list_transform(range({SEQ_LEN}), lambda x: 0), ' ') AS segment_ids "
    f"FROM (SELECT doc_id, line_no, list_concat([2], token_ids[1:{SEQ_LEN - 2}], [3]) AS e FROM ids)",
    *_WP_CTES, recursive=True))
def q_encode_line(spark, sf):
    ids, vocab = _ids(spark, sf)
    sp = wp.special_ids(vocab)
    tid, seg = wp.encode_ids(F.col("token_ids"), sp["[CLS]"], sp["[SEP]"], SEQ_LEN)
    return ids.select(*IDS, F.array_join(tid, " ").alias("token_ids"), F.array_join(seg, " ").alias("segment_ids"))


def _pair_sql() -> str:
    # consecutive lines of a file, both encoded as a pair with truncation (longer side first, second on ties)
    b = PAIR_LEN - 3
    return f"""
      SELECT a.doc_id, a.line_no,
             list_concat([2], a.token_ids[1:la - ca], [3], n.token_ids[1:lb - (ov - ca)], [3]) AS e,
             list_concat(list_transform(range(la - ca + 2), lambda x: 0), list_transform(range(lb - (ov - ca) + 1), lambda x: 1)) AS s
      FROM (SELECT a.*, n.token_ids AS nt, len(a.token_ids) AS la, len(n.token_ids) AS lb,
                   greatest(len(a.token_ids) + len(n.token_ids) - {b}, 0) AS ov,
                   CASE WHEN greatest(len(a.token_ids) + len(n.token_ids) - {b}, 0) <= abs(len(a.token_ids) - len(n.token_ids))
                        THEN CASE WHEN len(a.token_ids) > len(n.token_ids) THEN greatest(len(a.token_ids) + len(n.token_ids) - {b}, 0) ELSE 0 END
                        ELSE CASE WHEN len(a.token_ids) > len(n.token_ids) THEN abs(len(a.token_ids) - len(n.token_ids)) ELSE 0 END
                             + CAST(floor((greatest(len(a.token_ids) + len(n.token_ids) - {b}, 0) - abs(len(a.token_ids) - len(n.token_ids))) / 2) AS INTEGER)
                   END AS ca
            FROM ids a JOIN ids n ON n.doc_id = a.doc_id AND n.line_no = a.line_no + 1) a
      JOIN ids n ON n.doc_id = a.doc_id AND n.line_no = a.line_no + 1"""


@register("tokenize_pair", W(
    f"SELECT doc_id, line_no, array_to_string(list_concat(e, list_transform(range(greatest({PAIR_LEN} - len(e), 0)), "
    f"lambda x: 0)), ' ') AS token_ids, array_to_string(list_concat(s, list_transform(range(greatest({PAIR_LEN} - len(s), 0)), "
    f"lambda x: 0)), ' ') AS segment_ids FROM ({_pair_sql()})", *_WP_CTES, recursive=True))
def q_tokenize_pair(spark, sf):
    ids, vocab = _ids(spark, sf)
    sp = wp.special_ids(vocab)
    # a pair is cut to PAIR_LEN - 3 ids, the longer side first, so no later id of either side is ever in it; both sides
    # read the same stored ids
    ids = cut_lineage(ids.select(*IDS, F.slice("token_ids", 1, PAIR_LEN - 3).alias("token_ids")))
    nxt = ids.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("token_ids").alias("next_ids"))
    pairs = ids.join(nxt, IDS)  # unique (file, line) keys: no skew
    tid, seg = wp.encode_ids(F.col("token_ids"), sp["[CLS]"], sp["[SEP]"], PAIR_LEN, F.col("next_ids"))
    return pairs.select(*IDS, F.array_join(tid, " ").alias("token_ids"), F.array_join(seg, " ").alias("segment_ids"))


def _sig_sql() -> list:
    words = (f"SELECT doc_id, line_no, CAST(generate_subscripts(_w, 1) - 1 AS INTEGER) AS word_pos, unnest(_w) AS word0 "
             f"FROM (SELECT doc_id, line_no, list_transform({S.split_code('coalesce(line_contents, ' + chr(39) * 2 + ')')}, "
             f"lambda t: CASE WHEN {S.is_number('t')} THEN '0' ELSE t END) AS _w FROM v_lines)")
    sw = ("SELECT doc_id, line_no, word_pos, CASE WHEN word0 IN (SELECT token FROM vocab) THEN word0 ELSE "
          f"{S.token_signature('word0')} END AS word FROM sw0")
    return [("sw0", words), ("sw", sw)] + _walk_ctes("SELECT word FROM sw", "_s") + [
        ("sig", "SELECT l.doc_id, l.line_no, l.word_pos, CAST(p.piece_pos AS INTEGER) AS piece_pos, p.piece AS token "
                "FROM sw l JOIN pieces_s p ON l.word = p.word")]


@register("signature_word_piece", W("SELECT doc_id, line_no, word_pos, piece_pos, token FROM sig",
                                    *_VOCAB_CTES, *_sig_sql(), recursive=True))
def q_signature_wp(spark, sf):
    cut = wp.signature_pieces(fx.v_lines_in_place(spark, sf), IDS, "line_contents", _vocab(spark, sf))
    each = posexplode_rows(cut, IDS, F.col("_pieces"), "word_pos", "_p")
    return posexplode_rows(each, [*IDS, "word_pos"], F.col("_p"), "piece_pos", "token") \
        .select(*IDS, F.col("word_pos").cast("int").alias("word_pos"), F.col("piece_pos").cast("int").alias("piece_pos"),
                "token")


@register("custom_tokenizer", W(
    "SELECT doc_id, line_no, CAST(generate_subscripts(_t, 1) - 1 AS INTEGER) AS tok_pos, unnest(_t) AS token FROM "
    f"(SELECT doc_id, line_no, {S.drop_blank(S.vocab_tokens('line_contents'))} AS _t FROM v_lines)"))
def q_custom_tokenizer(spark, sf):
    # row 105: any Column -> Column tokenizer plugs into the tokenizing operators
    mine = (lambda c: drop_blank_tokens(vocab_tokens(c)))
    toks = wp.tokenize_lines(fx.v_lines(spark, sf), IDS, "line_contents", None, tokenizer=mine)
    return posexplode_rows(toks, IDS, F.col("tokens"), "tok_pos", "token") \
        .select(*IDS, F.col("tok_pos").cast("int").alias("tok_pos"), "token")
