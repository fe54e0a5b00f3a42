"""Token statistics and the vocabulary table (rows 13, 36, 63, 88)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import vocab_tokens
from ..schemas import BASE_TOKENS, SIGNATURE_TOKENS, TOKEN_NUMBER, VOCAB_CHARS
from .ordering import cpu_partitions, dense_index, posexplode_rows


def line_tokens(lines: DataFrame, line_col: str = "line_contents", order_cols=("doc_id", "line_no"),
                tokenizer=None) -> DataFrame:
    """One row per token: order columns, ``tok_pos`` (from 0) and ``token``."""
    tok = tokenizer or vocab_tokens
    return posexplode_rows(lines, list(order_cols), tok(F.col(line_col)), "tok_pos", "token")


#: Distinct tokens that a task counts before it hands them on.
COUNTED = 1 << 18


def _counter(tokens: str, order_cols: list[str]):
    """Per run of rows each token with its number and its first place."""
    def batch(b):
        col = b.column(b.schema.get_field_index(tokens))
        flat = col.flatten().dictionary_encode(null_encoding="encode")
        index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(np.asarray(col.offsets))
        rows = np.repeat(np.arange(b.num_rows), sizes)
        place = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = pa.table([b.column(c) for c in order_cols], names=order_cols)
        order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in order_cols], null_placement="at_start").to_numpy() if order_cols else np.arange(b.num_rows)
        same = np.ones(max(b.num_rows - 1, 0), bool)
        for c in order_cols:
            x = keys.column(c).take(pa.array(order)).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same &= x[1:] == x[:-1]
        rank = np.empty(b.num_rows, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(~same)])[:b.num_rows]
        key = rank[rows] << 31 | place
        at = np.lexsort((key, index))
        start = np.flatnonzero(np.concatenate([[True], np.diff(index[at]) > 0])) if len(at) else np.zeros(0, np.int64)
        first = at[start]
        n = np.diff(np.append(start, len(at)))
        return pa.table([flat.dictionary.take(pa.array(index[first])), pa.array(n.astype(np.int64)),
                         *(b.column(c).take(pa.array(rows[first])) for c in order_cols), pa.array(place[first].astype(np.int32))],
                        names=["token", "n", *order_cols, "tok_pos"])

    def merged(tables):
        t = pa.concat_tables(tables)
        t = t.sort_by([(c, "ascending") for c in (*order_cols, "tok_pos")], null_placement="at_start")
        firsts = [(c, "first", pc.ScalarAggregateOptions(skip_nulls=False)) for c in (*order_cols, "tok_pos")]
        out = t.group_by("token", use_threads=False).aggregate([("n", "sum"), *firsts])
        return out.select(["token", "n_sum", *(f"{c}_first" for c in order_cols), "tok_pos_first"]).rename_columns(t.column_names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                held.append(batch(b.slice(at, 4096)))
                n += held[-1].num_rows
                if n > 4 * COUNTED:
                    held = [merged(held)]
                    n = held[0].num_rows
                    if n > COUNTED:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, n = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)
    return run


def token_counts(lines: DataFrame, line_col: str = "line_contents", order_cols=("doc_id", "line_no"),
                 tokenizer=None, dealt: bool = False) -> DataFrame:
    """Row 36: ``token, n, first_pos``.  A task counts the tokens of its lines (at most some 1,000,000 entries at a time)
    before anything is sorted or shuffled, so neither all tokens nor a hot one travel.  Lines that lie in many tasks
    already (``dealt``) do not travel either."""
    tok = tokenizer or vocab_tokens
    order_cols = list(order_cols)
    # lines of a partition are tokenized where they are: adaptive execution would make few tasks of them
    src = (lines if dealt else lines.repartition(cpu_partitions(lines))).select(*order_cols, tok(F.col(line_col)).alias("_tokens"))
    src = src.withColumn("_tokens", F.coalesce("_tokens", F.array().cast("array<string>")))
    fields = [T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), *(src.schema[c] for c in order_cols),
              T.StructField("tok_pos", T.IntegerType())]
    counted = src.mapInArrow(_counter("_tokens", order_cols), T.StructType(fields))
    return counted.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct(*order_cols, "tok_pos")).alias("first_pos"))


def most_common_tokens(lines: DataFrame, n: int | None = None, line_col: str = "line_contents",
                       order_cols=("doc_id", "line_no"), tokenizer=None) -> DataFrame:
    """Row 63: ``rank, token, n`` by count descending, ties by first appearance; all
    tokens, or the ``n`` most common."""
    counts = token_counts(lines, line_col, order_cols, tokenizer)
    ranked = dense_index(counts, [-F.col("n"), F.col("first_pos")], "rank", start=1)
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return ranked.select(F.col("rank").cast("int").alias("rank"), "token", "n")


def build_vocab(lines: DataFrame, line_col: str = "line_contents", order_cols=("doc_id", "line_no"),
                use_signatures: bool = False, add_chars: bool = False, add_num_token: bool = False,
                min_count: int | None = None, min_token_length: int | None = None,
                tokenizer=None, dealt: bool = False) -> DataFrame:
    """Row 88: ``token, token_id, n``.

    Literal entries first (base tokens, optional [NUMBER], signature tokens and
    characters), then corpus tokens by frequency (ties: first appearance).  Q14
    fixed: ``min_count`` compares the count; base tokens and requested literal
    entries are exempt.  ``min_token_length`` drops ``##`` pieces shorter than it.
    Empty tokens (Q15) are dropped.  Ids are dense after pruning.
    """
    spark = lines.sparkSession
    literals = list(BASE_TOKENS)
    if add_num_token:
        literals.append(TOKEN_NUMBER)
    if use_signatures:
        for t in SIGNATURE_TOKENS:
            literals += [t, "##" + t]
    if add_chars:
        literals += ["##" + c for c in VOCAB_CHARS] + list(VOCAB_CHARS)
    seen, ordered = set(), []
    for t in literals:
        if t not in seen:
            seen.add(t)
            ordered.append(t)
    if min_token_length:  # the literal block is known here: prune it on the driver
        ordered = [t for t in ordered if not (t.startswith("##") and len(t) < min_token_length + 2)]
    lit_df = spark.createDataFrame([(t, i) for i, t in enumerate(ordered)], "token string, token_id long")

    # the counts feed both the corpus part and the literal part: written once
    from ..session import cut_lineage
    counts = cut_lineage(token_counts(lines, line_col, order_cols, tokenizer, dealt).where(F.col("token") != ""))
    corpus = counts.join(F.broadcast(lit_df), "token", "left_anti")  # literal table: fixed size
    if min_count:
        corpus = corpus.where(F.col("n") >= min_count)
    if min_token_length:
        corpus = corpus.where(~(F.col("token").startswith("##") & (F.length("token") < min_token_length + 2)))
    lit_part = lit_df.join(counts.select("token", "n"), "token", "left") \
        .select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n"))
    body = dense_index(corpus, [-F.col("n"), F.col("first_pos")], "token_id", start=len(ordered)) \
        .select("token", "token_id", "n")
    return lit_part.unionByName(body)


def load_vocab(vocab: DataFrame, limit: int | None = None) -> DataFrame:
    """Row 13: the first ``limit`` entries of a vocabulary table (id = position)."""
    return vocab if limit is None else vocab.where(F.col("token_id") < limit)
