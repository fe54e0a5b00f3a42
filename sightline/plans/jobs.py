"""Training, classification, evaluation and pair jobs (rows 11, 89, 91, 95-98) from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learn as ln
from ..operators import metrics as mt
from ..operators import pairs as pr
from ..operators import wordpiece as wp
from ..operators.ordering import dense_index
from ..operators.vocab import load_vocab
from ..session import cut_lineage

PARTS = ("all", "train", "val", "test")


def split_parts(df: DataFrame, id_cols: list[str], train: float, val: float | None = None, seed: int = 0) -> DataFrame:
    """Row 92: ``df`` with ``split``: by rank of md5(seed | ids) the first ``floor(n * train)`` rows are 'train', the
    next ``floor(n * val)`` 'val' (all that is left without ``val``), the rest 'test'.  Rows are numbered in ranges of
    the hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
    n = df.count()  # one scalar
    ranked = dense_index(df.withColumn("_h", key), [F.col("_h")], "_rk")
    first, second = int(n * train), n if val is None else int(n * train) + int(n * val)
    return ranked.withColumn("split", F.when(F.col("_rk") < first, "train").when(F.col("_rk") < second, "val").otherwise("test")) \
        .drop("_h", "_rk")


def choose_part(df: DataFrame, part: str) -> DataFrame:
    """Rows of one part of ``split_parts``, or 'all'."""
    if part not in PARTS:
        raise ValueError(f"no part {part!r}; parts are {', '.join(PARTS)}")
    return df if part == "all" else df.where(F.col("split") == part)


def evaluate_lines(df: DataFrame, model, truth: str = "commented", line_col: str = "line_contents", part: str = "all",
                   threshold: float = 0.5, tokenizer=None) -> tuple[DataFrame, DataFrame]:
    """Row 97: (report, confusion) of a line model on one part of labelled lines.  The scored rows are stored once for
    both."""
    scored = cut_lineage(ln.classify_lines(choose_part(df, part), model, None, line_col, threshold, tokenizer).select(truth, "commented_pred"))
    return mt.binary_report(scored, truth, "commented_pred"), mt.confusion_counts(scored, truth, "commented_pred", labels=[0, 1])


def evaluate_comments(df: DataFrame, model, purposes: list[str], subjects: list[str], message_col: str = "message",
                      purpose_col: str = "purpose", part: str = "all", tokenizer=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row 98: (report per target, confusion of the purpose, confusion per subject) on one part of labelled comments."""
    preds = ["pred_" + s for s in subjects]
    scored = ln.classify_comments(choose_part(df, part), message_col, model, purposes, subjects, tokenizer=tokenizer)
    scored = cut_lineage(scored.select(purpose_col, "pred_purpose", *subjects, *preds))
    return (mt.comment_report(scored, purpose_col, "pred_purpose", subjects, preds),
            mt.confusion_counts(scored, purpose_col, "pred_purpose", labels=purposes),
            mt.multilabel_confusion(scored, subjects, preds))


def line_pairs(lines: DataFrame, vocab: DataFrame, vocab_size: int | None = None, signatures: bool = False,
               omit_whitespace: bool = False, period: int = 64, per_shard: int = 10000, tokenizer=None, file_col: str = "doc_id",
               no_col: str = "line_no", line_col: str = "line_contents") -> DataFrame:
    """Row 89: accepted pairs of consecutive lines with the word pieces of both: ``pair_seq, shard, file, line number,
    left_tokens, right_tokens``.

    ``vocab_size`` takes the first entries of the vocabulary; ``signatures`` cuts words that are no entries by their
    signature; ``omit_whitespace`` leaves blank tokens out; ``tokenizer`` (Column -> Column) gives the words instead."""
    ids = [file_col, no_col]
    vocab = load_vocab(vocab, vocab_size)
    pairs = pr.shard_pairs(pr.generate_pairs(lines, period, file_col, no_col, line_col, texts=False).drop("left", "right"), per_shard)
    dealt = pr.deal_lines(pairs, lines, "shard", file_col, no_col, line_col)
    got = wp.paired_pieces(dealt, pairs.schema, "shard", line_col, vocab, not omit_whitespace, tokenizer, signatures)
    if got is not None:
        return got
    cut = wp.signature_word_pieces if signatures else wp.tokenize_lines
    toks = cut_lineage(cut(lines, ids, line_col, vocab, preserve_whitespace=not omit_whitespace, tokenizer=tokenizer))
    nxt = toks.select(file_col, (F.col(no_col) - 1).alias(no_col), F.col("tokens").alias("right_tokens"))
    return pairs.join(toks.withColumnRenamed("tokens", "left_tokens"), ids).join(nxt, ids)  # unique (file, line) keys
