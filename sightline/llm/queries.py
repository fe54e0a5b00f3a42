"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, hadamard_codes, html_blocks, minhash, mixing, pitman_yor, quality, resample, sentencepiece, suffix_dedup,
               threshold_search, toxicity, vbyte)
from .common import table, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pitman_yor(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents"))


@query
def op2_html_blocks(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op3_sentencepiece(spark, sf_dir):
    """Pieces of every whole text, and the digest of the text that decoding them gives back."""
    path = tokenizer_file("piece_bpe_32k.model")
    coded = sentencepiece.encode(table(spark, sf_dir, "documents"), path)
    told = sentencepiece.decode(coded, path)
    return told.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


@query
def op4_vbyte_ids(spark, sf_dir):
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return vbyte.read_ids(spark, path).drop("ids")


@query
def op5_mix_sources(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_batch(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


@query
def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op10_bbit_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_uniform_threshold(spark, sf_dir):
    return threshold_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op12_hadamard_codes(spark, sf_dir):
    return hadamard_codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op13_head_tail_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op8_exact_dedup"] = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents) d
JOIN (SELECT sha256(coalesce(text, '')) AS text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
      FROM documents GROUP BY 1) g USING (text_sha256)"""

_KEPT = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE_SQL["op11_uniform_threshold"] = f"""
WITH kept AS ({_KEPT.format(scale=256)}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
           FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5"""


def _codes_sql() -> str:
    """Six rounds of assigning and averaging, one common table expression each."""
    cut = "SELECT {cols}, p, s, v[p * (len(v) // 8) + s + 1] AS x FROM {src}, range(8) a(p), range(64) b(s) WHERE s < len(v) // 8"
    steps = [f"kept AS ({_KEPT.format(scale=4096)})", f"xs AS ({cut.format(cols='vec_id', src='kept')})",
             "first AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM (SELECT * FROM kept ORDER BY vec_id LIMIT 16))",
             f"b0 AS ({cut.format(cols='e', src='first')})"]
    for r in range(7):
        steps.append(f"""d{r} AS (SELECT vec_id, xs.p, e, sum((xs.x - b.x) * (xs.x - b.x))::BIGINT AS d
            FROM xs JOIN b{r} b ON xs.p = b.p AND xs.s = b.s GROUP BY ALL)""")
        steps.append(f"a{r} AS (SELECT vec_id, p, min(d * 16 + e) % 16 AS e, min(d) AS d FROM d{r} GROUP BY ALL)")
        if r < 6:
            steps.append(f"""b{r + 1} AS (SELECT b.e, b.p, b.s, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN
                (SELECT e, p, s, floor(sum(x) / count(*))::BIGINT AS x FROM xs JOIN a{r} USING (vec_id, p) GROUP BY ALL) m
                ON b.e = m.e AND b.p = m.p AND b.s = m.s)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, s)) FROM b6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL["op12_hadamard_codes"] = _codes_sql()

#: CRC-32 by its table of 256 steps, itself from eight shifts; over the hexadecimal digits of a word's UTF-8 bytes.
ORACLE_SQL["op13_head_tail_resample"] = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
words AS (SELECT doc_id, of_target, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT doc_id, text, false AS of_target FROM documents UNION ALL SELECT item_id, text, true FROM benchmark)),
counts AS (SELECT w, of_target, doc_id, count(*) AS n FROM words GROUP BY ALL),
coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2),
         lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words), steps),
held AS (SELECT bucket, of_target, sum(n) AS n FROM counts JOIN coded USING (w) GROUP BY ALL),
gains AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM held WHERE NOT of_target) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM held WHERE of_target) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN held s ON s.bucket = b AND NOT s.of_target LEFT JOIN held t ON t.bucket = b AND t.of_target),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM counts JOIN coded USING (w) JOIN gains USING (bucket) WHERE NOT of_target GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked"""
