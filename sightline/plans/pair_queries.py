"""Queries for the line-pair rows (11, 53, 59-61, 65, 89, 91)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import pairs as pr
from ..operators import wordpiece as wp
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import jobs
from . import sqltext as S
from .catalog import register
from .corpus_queries import _VOCAB_CTES, _WP_CTES, _vocab, _walk_ctes
from .io_queries import scratch

W = fx.with_views
PERIOD = 64
PER_SHARD = 1000
BATCH = 32
LIMIT = 2000
MASK_LEN = 48

_PAIR_CTES = [
    ("cons", "SELECT a.doc_id, a.line_no, a.line_contents AS lft, b.line_contents AS rgt FROM v_lines a "
             "JOIN v_lines b ON b.doc_id = a.doc_id AND b.line_no = a.line_no + 1"),
    ("offs", "SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off "
             "FROM (SELECT doc_id, count(*) AS n FROM v_lines GROUP BY doc_id)"),
    ("buck", f"SELECT l.doc_id, l.line_no, CAST(coalesce(o.off, 0) + l.line_no - 1 AS BIGINT) AS gidx, "
             f"CAST((coalesce(o.off, 0) + l.line_no - 1) // {PERIOD} AS BIGINT) AS bucket FROM v_lines l "
             f"JOIN offs o ON l.doc_id = o.doc_id"),
    ("pcand", "SELECT c.*, b.gidx, b.bucket FROM cons c JOIN buck b ON c.doc_id = b.doc_id AND c.line_no = b.line_no"),
    ("ordc", "MATERIALIZED: SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY gidx) AS k FROM pcand"),
    ("fold", "SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs, "
             "CAST([] AS BIGINT[]) AS acc FROM ordc UNION ALL "
             "SELECT f.bucket, o.k, "
             "CASE WHEN NOT list_contains(f.ls, o.lft) AND NOT list_contains(f.rs, o.rgt) THEN list_append(f.ls, o.lft) ELSE f.ls END, "
             "CASE WHEN NOT list_contains(f.ls, o.lft) AND NOT list_contains(f.rs, o.rgt) THEN list_append(f.rs, o.rgt) ELSE f.rs END, "
             "CASE WHEN NOT list_contains(f.ls, o.lft) AND NOT list_contains(f.rs, o.rgt) THEN list_append(f.acc, o.gidx) ELSE f.acc END "
             "FROM fold f JOIN ordc o ON o.bucket = f.bucket AND o.k = f.k + 1"),
    ("kept", "SELECT unnest(acc) AS gidx FROM (SELECT bucket, arg_max(acc, k) AS acc FROM fold GROUP BY bucket)"),
    ("accepted", "SELECT c.*, row_number() OVER (ORDER BY c.gidx) - 1 AS pair_seq FROM pcand c WHERE c.gidx IN (SELECT gidx FROM kept)"),
]


def _accepted(spark, sf):
    return pr.shard_pairs(pr.generate_pairs(fx.v_lines_in_place(spark, sf), PERIOD, texts=False), PER_SHARD)


@register("consecutive_lines", W("SELECT doc_id, line_no, lft AS left, rgt AS right FROM cons", *_PAIR_CTES))
def q_consecutive(spark, sf):
    return pr.consecutive_lines(fx.v_lines(spark, sf))


@register("line_buckets", W("SELECT doc_id, line_no, gidx, bucket FROM buck", *_PAIR_CTES))
def q_buckets(spark, sf):
    return pr.line_buckets(fx.v_lines(spark, sf), PERIOD)


@register("unique_pairs", W("SELECT doc_id, line_no, gidx, bucket FROM accepted", *_PAIR_CTES, recursive=True))
def q_unique_pairs(spark, sf):
    return pr.generate_pairs(fx.v_lines_in_place(spark, sf), PERIOD, texts=False).select("doc_id", "line_no", "gidx", "bucket")


@register("write_shards", W(f"SELECT doc_id, line_no, pair_seq, CAST(pair_seq // {PER_SHARD} AS BIGINT) AS shard "
                            "FROM accepted", *_PAIR_CTES, recursive=True))
def q_shards(spark, sf):
    path = scratch(spark, "shards")
    pr.write_shards(pr.with_texts(_accepted(spark, sf), fx.v_lines_in_place(spark, sf)), path, dealt=True)
    return spark.read.parquet(path).select("doc_id", "line_no", "pair_seq", F.col("shard").cast("long").alias("shard"))


@register("steps_per_epoch", W(f"SELECT CAST(floor(count(*) / {BATCH}) AS BIGINT) AS steps_per_epoch FROM accepted",
                               *_PAIR_CTES, recursive=True))
def q_steps(spark, sf):
    return mt.steps_per_epoch(pr.generate_pairs(fx.v_lines_in_place(spark, sf), PERIOD, texts=False), BATCH)


@register("epoch_order", W(
    "SELECT epoch, shard, CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5('0|' || CAST(epoch AS VARCHAR) || '|' "
    f"|| CAST(shard AS VARCHAR))) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT CAST(pair_seq // {PER_SHARD} AS BIGINT) "
    "AS shard FROM accepted), range(0, 3) e(epoch)", *_PAIR_CTES, recursive=True))
def q_epoch(spark, sf):
    return pr.epoch_order(_accepted(spark, sf), 3).select("epoch", "shard", "position")


def _shown(pairs):
    return pairs.select("pair_seq", "shard", F.array_join("left_tokens", " ").alias("left_tokens"),
                        F.array_join("right_tokens", " ").alias("right_tokens"))


@register("line_pairs", W(
    f"SELECT a.pair_seq, CAST(a.pair_seq // {PER_SHARD} AS BIGINT) AS shard, array_to_string(l.tokens, ' ') AS left_tokens, "
    "array_to_string(r.tokens, ' ') AS right_tokens FROM accepted a JOIN wp_lines l ON l.doc_id = a.doc_id AND "
    "l.line_no = a.line_no JOIN wp_lines r ON r.doc_id = a.doc_id AND r.line_no = a.line_no + 1",
    *_PAIR_CTES, *_WP_CTES, recursive=True))
def q_line_pairs(spark, sf):
    return _shown(jobs.line_pairs(fx.v_lines_in_place(spark, sf), _vocab(spark, sf), period=PERIOD, per_shard=PER_SHARD))


_LIMITED = [(n, q) if n != "vocab" else ("vocab", f"SELECT * FROM ({q}) WHERE token_id < {LIMIT}") for n, q in _VOCAB_CTES]
_SIG_WORDS = S.drop_blank(S.split_code("coalesce(line_contents, '')"))
_SIG_CTES = [
    ("sw0", f"SELECT doc_id, line_no, CAST(generate_subscripts(_w, 1) - 1 AS INTEGER) AS word_pos, unnest(_w) AS word0 FROM "
            f"(SELECT doc_id, line_no, list_transform({_SIG_WORDS}, lambda t: CASE WHEN {S.is_number('t')} THEN '0' ELSE t END) AS _w FROM v_lines)"),
    ("sw", f"SELECT doc_id, line_no, word_pos, CASE WHEN word0 IN (SELECT token FROM vocab) THEN word0 ELSE {S.token_signature('word0')} END "
           "AS word FROM sw0"),
    *_walk_ctes("SELECT word FROM sw", "_s"),
    ("sig_lines", "SELECT l.doc_id, l.line_no, coalesce(t.tokens, []) AS tokens FROM v_lines l LEFT JOIN (SELECT w.doc_id, w.line_no, "
                  "list(p.piece ORDER BY w.word_pos, p.piece_pos) AS tokens FROM sw w JOIN pieces_s p ON w.word = p.word GROUP BY ALL) t "
                  "ON l.doc_id = t.doc_id AND l.line_no = t.line_no")]


@register("line_pairs_signatures", W(
    f"SELECT a.pair_seq, CAST(a.pair_seq // {PER_SHARD} AS BIGINT) AS shard, array_to_string(l.tokens, ' ') AS left_tokens, "
    "array_to_string(r.tokens, ' ') AS right_tokens FROM accepted a JOIN sig_lines l ON l.doc_id = a.doc_id AND "
    "l.line_no = a.line_no JOIN sig_lines r ON r.doc_id = a.doc_id AND r.line_no = a.line_no + 1",
    *_PAIR_CTES, *_LIMITED, *_SIG_CTES, recursive=True))
def q_line_pairs_signatures(spark, sf):
    """Row 89 with signatures, without white space, and the first entries of the vocabulary only."""
    return _shown(jobs.line_pairs(fx.v_lines_in_place(spark, sf), _vocab(spark, sf), LIMIT, signatures=True, omit_whitespace=True, period=PERIOD,
                                  per_shard=PER_SHARD))


def _hash_sql(kind: str, *parts: str) -> str:
    return f"('0x' || substr(md5('0|{kind}|' || " + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8))::BIGINT"


def _masked_sql() -> list[tuple[str, str]]:
    b = MASK_LEN - 3
    draw = _hash_sql("k", "pair_seq", "i - 1") + " / 4294967296.0::DOUBLE"
    return [
        ("pe", f"SELECT a.pair_seq, a.pair_seq // {PER_SHARD} AS shard, l.token_ids AS lt, r.token_ids AS rt FROM accepted a "
               "JOIN ids l ON l.doc_id = a.doc_id AND l.line_no = a.line_no JOIN ids r ON r.doc_id = a.doc_id AND r.line_no = a.line_no + 1"),
        ("sh", "SELECT shard, min(pair_seq) AS lo, count(*) AS n FROM pe GROUP BY shard"),
        ("sw", f"SELECT p.pair_seq, p.lt, CASE WHEN {_hash_sql('s', 'p.pair_seq')} / 4294967296.0::DOUBLE < 0.5 THEN 0 ELSE 1 END AS is_next, "
               f"CASE WHEN {_hash_sql('s', 'p.pair_seq')} / 4294967296.0::DOUBLE < 0.5 THEN o.rt ELSE p.rt END AS rt FROM pe p "
               "JOIN sh ON sh.shard = p.shard JOIN pe o ON o.pair_seq = sh.lo + (p.pair_seq - sh.lo + 1) % sh.n"),
        ("sz", f"SELECT *, len(lt) AS la, len(rt) AS lb, greatest(len(lt) + len(rt) - {b}, 0) AS ov, abs(len(lt) - len(rt)) AS d FROM sw"),
        ("ct", "SELECT *, CASE WHEN ov <= d THEN CASE WHEN la > lb THEN ov ELSE 0 END ELSE CASE WHEN la > lb THEN d ELSE 0 END + "
               "CAST(floor((ov - d) / 2) AS INTEGER) END AS ca FROM sz"),
        ("sq", "SELECT pair_seq, is_next, list_concat([2], lt[1:la - ca], [3], rt[1:lb - (ov - ca)], [3]) AS t, "
               "list_concat(list_transform(range(la - ca + 2), lambda x: 0), list_transform(range(lb - (ov - ca) + 1), lambda x: 1)) AS s FROM ct"),
        ("hs", "SELECT *, list_transform(t, lambda x, i: CASE WHEN x IN (2, 3) THEN NULL ELSE "
               f"{_hash_sql('m', 'pair_seq', 'i - 1')} / 4294967296.0::DOUBLE END) AS h FROM sq"),
        ("ch", "SELECT *, list_transform(h, lambda x: CAST(coalesce(x < 0.15 OR x = list_min(h), false) AS INTEGER)) AS c FROM hs"),
        ("mx", f"SELECT pair_seq, is_next, t, s, c, list_transform(t, lambda x, i: CASE WHEN c[i] = 0 THEN x WHEN {draw} < 0.8 THEN 4 "
               f"WHEN {draw} < 0.8::DOUBLE + 0.1::DOUBLE THEN CAST({_hash_sql('r', 'pair_seq', 'i - 1')} % nv AS INTEGER) "
               "ELSE x END) AS m FROM ch, (SELECT count(*) AS nv FROM vocab)"),
    ]


def _padded(col: str) -> str:
    return f"array_to_string(list_concat({col}, list_transform(range({MASK_LEN} - len({col})), lambda x: 0)), ' ')"


@register("masked_examples", W(
    f"SELECT pair_seq, is_next, {_padded('m')} AS token_ids, {_padded('s')} AS segment_ids, {_padded('t')} AS target_ids, "
    f"{_padded('c')} AS masked FROM mx", *_PAIR_CTES, *_WP_CTES, *_masked_sql(), recursive=True))
def q_masked(spark, sf):
    vocab = _vocab(spark, sf)
    pairs = jobs.line_pairs(fx.v_lines_in_place(spark, sf), vocab, period=PERIOD, per_shard=PER_SHARD)
    keys = ["pair_seq", "shard"]
    # an example has MASK_LEN - 3 ids of its lines, the longer one cut first: later ones are never in it
    pairs = pairs.select(*keys, *[F.slice(c, 1, MASK_LEN - 3).alias(c) for c in ("left_tokens", "right_tokens")])
    left = wp.vocab_lookup(pairs, [*keys, "right_tokens"], "left_tokens", vocab, "left_ids")
    both = cut_lineage(wp.vocab_lookup(left, [*keys, "left_ids"], "right_tokens", vocab, "right_ids"))
    m = pr.masked_examples(both, vocab.count(), wp.special_ids(vocab), MASK_LEN)
    arrays = ["token_ids", "segment_ids", "target_ids", "masked"]
    return m.select("pair_seq", "is_next", *[F.array_join(c, " ").alias(c) for c in arrays])
