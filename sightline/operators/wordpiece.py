"""Word pieces, vocabulary lookup and encoding (rows 30, 75-78, 105).

Greedy longest-match word pieces: the vocabulary goes to every task, as a trie with failure links where it is small,
else packed in flat arrays (``packed.py``).  Lines are cut where they are, batch by batch, each distinct word of a batch
once, so no line is stored, no token is shuffled, and a word that holds a third of all tokens is no hot key.  That path
is for vocabularies of at most ``VOCAB_CHARS`` characters, which is checked.  Of a larger one the ``HEAD_TOKENS`` first
entries go to every task: a word among them is a piece of its own, and only a line's other words (each once) are joined:
with the vocabulary, and those that are no entries as distinct words -> every (start, length) substring -> longest entry
per start -> a fold over the word's positions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import drop_blank_tokens, is_number, signature_of, split_code, token_signature
from ..schemas import TOKEN_CLS, TOKEN_MASK, TOKEN_NUMBER, TOKEN_SEP, TOKEN_UNK
from ..session import cut_lineage
from .ordering import cpu_partitions, posexplode_rows
from .packed import PackedVocabulary
from .trie import PieceTrie

#: Characters of a vocabulary that goes to every task (some 5 bytes each in a worker), and of one that goes there as a
#: trie, which has at most twice as many nodes.
VOCAB_CHARS, TRIE_CHARS = 1 << 25, 1 << 16
#: Entries of a larger vocabulary that go to every task, and the longest one among them (in characters).
HEAD_TOKENS, HEAD_LENGTH = 1 << 17, 64
#: Words whose pieces a worker keeps before it starts afresh.
KEPT_WORDS = 200_000

_vocabularies: dict[str, TrieVocabulary | PackedVocabulary] = {}


def code_words(line: Column, preserve_whitespace: bool = True, use_digit_token: bool = True) -> Column:
    """Words of a line before word pieces: split (68), optionally drop blanks (69),
    all-digit words -> [NUMBER] (73)."""
    w = split_code(F.coalesce(line, F.lit("")))
    if not preserve_whitespace:
        w = drop_blank_tokens(w)
    return _numbers_as(line, w, TOKEN_NUMBER) if use_digit_token else w


def _numbers_as(line: Column, words: Column, token: str) -> Column:
    """``words`` with ``token`` for all-digit ones, which are only looked for in lines with a digit."""
    told = F.transform(words, lambda t: F.when(is_number(t), F.lit(token)).otherwise(t))
    return F.when(line.rlike(r"\p{Nd}"), told).otherwise(words)


def signature_words(line: Column, vocab_words: Column | None = None, preserve_whitespace: bool = True) -> Column:
    """Row 76 words: digits -> "0"; the signature replaces words outside the
    vocabulary (that test is a join, see ``signature_word_pieces``)."""
    w = split_code(F.coalesce(line, F.lit("")))
    if not preserve_whitespace:
        w = drop_blank_tokens(w)
    return _numbers_as(line, w, "0")


class TrieVocabulary:
    """A small vocabulary in a worker: entries by text, words cut by a trie and kept."""

    def __init__(self, tokens: pa.Array, ids: np.ndarray):
        self.row = {t: i for i, t in enumerate(tokens.to_pylist())}
        self.ids, self.trie, self.kept = ids, PieceTrie(self.row), {}

    def find(self, words: pa.Array) -> np.ndarray:
        return np.array([self.row.get(w, -1) for w in words.to_pylist()], np.int64)

    def find_ids(self, words: pa.Array, unknown: int) -> np.ndarray:
        return np.array([unknown if i < 0 else self.ids[i] for i in self.find(words)], np.int64)

    def pieces(self, words: pa.Array) -> list[list[str]]:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        out = []
        for w in words.to_pylist():
            p = self.kept.get(w)
            if p is None:
                p = self.trie.pieces(w)
                if len(w) < 100:
                    self.kept[w] = p
            out.append(p)
        return out


def told_vocabulary(vocab: DataFrame):
    """The vocabulary's tokens (with ids where it has them) for every task, or None where it is too large for that.  Made
    once for a table."""
    if getattr(vocab, "_told_size", None) is None:
        vocab._told_size = vocab.agg(F.sum(F.length("token") + 1).alias("n")).first()["n"] or 0
    if vocab._told_size > VOCAB_CHARS:
        return None
    if getattr(vocab, "_told", None) is None:
        id_ = F.col("token_id") if "token_id" in vocab.columns else F.lit(-1)
        rows = vocab.where(F.col("token").isNotNull()).select("token", id_.cast("long").alias("i")).toArrow()  # at most VOCAB_CHARS characters
        tokens, ids = rows.column("token").combine_chunks(), rows.column("i").combine_chunks()
        kind = TrieVocabulary if vocab._told_size <= TRIE_CHARS else PackedVocabulary
        vocab._told = uuid.uuid4().hex, vocab.sparkSession.sparkContext.broadcast((kind, tokens, ids.to_numpy(zero_copy_only=False)))
    return vocab._told


def _vocabulary(key: str, told) -> TrieVocabulary | PackedVocabulary:
    """This worker's own form of a vocabulary."""
    if key not in _vocabularies:
        pa.default_memory_pool().release_unused()  # of earlier stages in this worker
        if len(_vocabularies) >= 2:
            _vocabularies.clear()
        kind, tokens, ids = told.value
        _vocabularies[key] = kind(tokens, ids)
        vars(told).pop("_value", None)  # the copy of what was sent
    return _vocabularies[key]


def _cut(known, col, whole: frozenset, instead: Callable | None, flat: bool):
    """Each row's pieces, word by word or (``flat``) one after the other; a word of ``whole`` is one piece.  With
    ``instead``, a word that is no entry is cut as what that gives for it."""
    every = col.flatten().dictionary_encode()
    texts, index = every.dictionary, every.indices
    asked = texts
    if instead:
        asked = pa.array([t if i >= 0 else instead(t) for t, i in zip(texts.to_pylist(), known.find(texts).tolist())], pa.string())
    cut = known.pieces(asked)
    if whole:
        cut = [[w] if w in whole else p for w, p in zip(texts.to_pylist(), cut)]
    of_word = pa.array(cut, pa.list_(pa.string())).take(index)
    sizes = np.concatenate([[0], np.cumsum(np.diff(np.asarray(col.offsets)))])
    if flat:
        n = of_word.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sizes, of_word = np.concatenate([[0], np.cumsum(n)])[sizes], of_word.flatten()
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), of_word)


def _cutter(told, words: str, whole: frozenset, instead: Callable | None, flat: bool):
    """Adds each row's pieces in place."""
    def run(batches):
        known = _vocabulary(*told)
        for b in batches:
            pieces = _cut(known, b.column(b.schema.get_field_index(words)), whole, instead, flat)
            keep = [i for i, n in enumerate(b.schema.names) if n != words]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pieces], [*(b.schema.names[i] for i in keep), "_pieces"])
    return run


def _pairer(told, whole: frozenset, instead: Callable | None, cols: list[str], by: str):
    """The lines of one value of ``by``, each cut once -> its pairs with the pieces of both lines."""
    def run(t: pa.Table) -> pa.Table:
        known = _vocabulary(*told)
        words, of = (t.column(c).combine_chunks() for c in ("_words", "_of"))
        words, of = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (words, of))
        tokens = _cut(known, words, whole, instead, True)
        row, x = of.value_parent_indices().to_numpy(), of.flatten()
        right = x.field("_right").to_numpy(zero_copy_only=False)
        seq = x.field("pair_seq").to_numpy(zero_copy_only=False)
        left, rest = np.flatnonzero(~right), np.flatnonzero(right)
        rest = rest[np.argsort(seq[rest], kind="stable")]
        lo, hi = (np.searchsorted(seq[rest], seq[left], side) for side in ("left", "right"))
        n = hi - lo  # every left line of a pair meets every right one
        ends = np.cumsum(n)
        a, b = np.repeat(left, n), rest[np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = pa.array(a)
        own = [pa.repeat(t.column(by)[0], len(a)) if c == by else x.field(c).take(at) for c in cols]
        return pa.table([*own, tokens.take(pa.array(row[a])), tokens.take(pa.array(row[b]))], names=[*cols, "left_tokens", "right_tokens"])
    return run


def paired_pieces(dealt: DataFrame, pair_schema: T.StructType, by: str, line_col: str, vocab: DataFrame, preserve_whitespace: bool = True,
                  tokenizer=None, signatures: bool = False) -> DataFrame | None:
    """Pairs of the lines that ``pairs.deal_lines`` has dealt, with ``left_tokens`` and ``right_tokens`` (as
    ``tokenize_lines`` or ``signature_word_pieces`` give them): a line is cut once, in the task of its pairs.  None for a
    vocabulary that is too large for every task."""
    told = told_vocabulary(vocab)
    if told is None:
        return None
    words, whole, instead = line_words(F.col(line_col), preserve_whitespace, tokenizer, signatures)
    strings = T.ArrayType(T.StringType())
    out = T.StructType([*pair_schema.fields, T.StructField("left_tokens", strings), T.StructField("right_tokens", strings)])
    rows = dealt.select(by, words.alias("_words"), "_of")
    return rows.groupBy(by).applyInArrow(_pairer(told, whole, instead, pair_schema.names, by), out)


def line_words(line: Column, preserve_whitespace: bool = True, tokenizer=None, signatures: bool = False):
    """What is cut of a line: its words, those that are a piece as they are, and what unknown words are cut as."""
    plain = signature_words(line, preserve_whitespace=preserve_whitespace) if signatures else code_words(line, preserve_whitespace)
    words = F.coalesce(tokenizer(line) if tokenizer is not None else plain, F.array().cast("array<string>"))
    return words, frozenset() if signatures else frozenset(["", TOKEN_NUMBER]), signature_of if signatures else None


def with_pieces(df: DataFrame, words: Column, vocab: DataFrame, whole=(TOKEN_NUMBER,), instead: tuple[Column, Callable] | None = None,
                empty: bool = False, flat: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with ``_pieces``: per word of the array ``words`` the array of its pieces, or (``flat``) all pieces of the
    row.  An empty word has none, or (``empty``) is a piece.  ``instead`` gives what is cut for words that are no entries:
    the array, and a function that makes each of its words of the word at its place."""
    told = told_vocabulary(vocab)
    keep, strings = df.columns if keep is None else keep, T.ArrayType(T.StringType())
    if told is not None:
        out = T.StructType([*df.select(*keep).schema.fields, T.StructField("_pieces", strings if flat else T.ArrayType(strings))])
        whole = frozenset(["", *whole] if empty else whole)
        return df.select(*keep, words.alias("_words")).mapInArrow(_cutter(told, "_words", whole, instead[1] if instead else None, flat), out)
    src = df.select(*keep, words.alias("_words"), (instead[0] if instead else words).alias("_instead"))
    head = told_head(vocab)
    got = cut_lineage(_with_left(src, "_words", head, frozenset(["", *whole]), "_instead"))
    asked = got.select("_row", F.explode(F.array_distinct(F.arrays_zip("_left", "_left_instead"))).alias("_k")) \
        .select("_row", F.col("_k._left").alias("_w"), F.col("_k._left_instead").alias("_o"))
    entries = vocab.where(F.col("token").isNotNull()).select(F.col("token").alias("_entry")).distinct()
    keys = asked.select("_w", "_o").distinct().join(entries, F.col("_w") == F.col("_entry"), "left")
    keys = cut_lineage(keys.select("_w", "_o", F.col("_entry").isNotNull().alias("_known")))
    cut = pieces_by_join(keys.where(~F.col("_known")), vocab, "_o")
    pieces = keys.where("_known").select("_w", "_o", F.array("_w").alias("pieces")).unionByName(
        keys.where(~F.col("_known")).join(cut, F.col("_o") == F.col("word"), "left")
        .select("_w", "_o", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces")))
    own = F.map_from_entries(F.collect_list(F.struct(F.struct("_w", "_o").alias("k"), "pieces"))).alias("_of")
    back = asked.join(pieces, ["_w", "_o"]).groupBy("_row").agg(own)
    none = lambda w: F.when(F.length(w) == 0, F.array(w) if empty else F.array().cast("array<string>"))
    shown = lambda c: (F.flatten(c) if flat else c).alias("_pieces")
    plain = got.where(F.size("_left") == 0).select(*keep, shown(F.transform("_words", lambda w: none(w).otherwise(F.array(w)))))
    joined = got.where(F.size("_left") > 0).join(back, "_row").select(*keep, shown(F.zip_with("_words", "_instead", lambda w, o: none(w).otherwise(
        F.coalesce(F.try_element_at("_of", F.struct(w.alias("_w"), o.alias("_o"))), F.array(w))))))
    return plain.unionAll(joined)


def told_head(vocab: DataFrame):
    """The first short entries of a vocabulary for every task (the frequent ones, where it is in that order): at most
    ``HEAD_TOKENS`` of ``HEAD_LENGTH`` characters.  They decide speed only."""
    cols = [c for c in ("token", "token_id") if c in vocab.columns]
    rows = vocab.where(F.length("token").between(1, HEAD_LENGTH)).select(*cols).orderBy(cols[-1]).limit(HEAD_TOKENS).collect()
    return uuid.uuid4().hex, vocab.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


_heads: dict[str, dict] = {}


def _head(key: str, tokens) -> dict:
    if key not in _heads:
        if len(_heads) >= 2:
            _heads.clear()
        _heads[key] = {t[0]: t[-1] for t in tokens.value}
    return _heads[key]


def _leaver(head, words: str, whole: frozenset, instead: str):
    """Adds each row's words that are neither in the head nor in ``whole``, with what stands at their places in
    ``instead``."""
    def run(batches):
        known = _head(*head)
        for b in batches:
            col = b.column(b.schema.get_field_index(words))
            flat = col.flatten().dictionary_encode()
            left = np.array([t not in known and t not in whole for t in flat.dictionary.to_pylist()], bool)
            on = left[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, bool)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(col.offsets)))
            sizes = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[on], minlength=b.num_rows))]).astype(np.int32))
            mask = pa.array(on)
            more = [pa.ListArray.from_arrays(sizes, b.column(b.schema.get_field_index(c)).flatten().filter(mask)) for c in (words, instead)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_left", "_left_instead"])
    return run


def _with_left(src: DataFrame, words: str, head, whole: frozenset, instead: str) -> DataFrame:
    strings = T.ArrayType(T.StringType())
    out = T.StructType([*src.schema.fields, T.StructField("_left", strings), T.StructField("_left_instead", strings)])
    return src.mapInArrow(_leaver(head, words, whole, instead), out).withColumn("_row", F.monotonically_increasing_id())


def pieces_by_join(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """``word, pieces`` for distinct words, by joining their substrings with a vocabulary of any size."""
    v = vocab.select(F.col("token").alias("_piece"), F.lit(True).alias("_hit"))
    lmax = v.select(F.max(F.length(F.regexp_replace("_piece", "^##", ""))).alias("m")).first()["m"] or 1  # scalar
    w = words.select(F.col(word_col).alias("word")).where(F.length("word") > 0).distinct().repartition(cpu_partitions(words), "word")
    cand = w.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    cand = cand.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(lmax), F.length("word") - F.col("s"))))
                       .alias("l"))
    cand = cand.withColumn("_piece", F.concat(F.when(F.col("s") > 0, F.lit("##")).otherwise(F.lit("")),
                                              F.substring(F.col("word"), F.col("s") + 1, F.col("l"))))
    # the longest entry at every start; a word without any is joined back to none
    longest = cand.join(v, "_piece").groupBy("word", "s").agg(F.max("l").alias("l"))
    hits = longest.groupBy("word").agg(F.collect_list(F.struct("s", "l")).alias("_found"))
    jumps = w.join(hits, "word", "left").select("word", F.coalesce("_found", F.array().cast("array<struct<s:int,l:int>>")).alias("_hits"))
    state = F.struct(F.lit(0).alias("nxt"), F.array().cast("array<string>").alias("ps"))

    def step(acc, i):
        best = F.array_max(F.transform(F.filter(F.col("_hits"), lambda h: h["s"] == i), lambda h: h["l"]))
        l = F.coalesce(best, F.lit(1))
        piece = F.concat(F.when(i > 0, F.lit("##")).otherwise(F.lit("")), F.substring(F.col("word"), i + 1, l))
        take = acc["nxt"] == i
        return F.struct(F.when(take, i + l).otherwise(acc["nxt"]).alias("nxt"),
                        F.when(take, F.concat(acc["ps"], F.array(piece))).otherwise(acc["ps"]).alias("ps"))

    walked = F.aggregate(F.sequence(F.lit(0), F.length("word") - 1), state, step)
    return jumps.select("word", walked["ps"].alias("pieces"))


def word_pieces_of(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """Row 75 core: ``word, pieces`` (array<string>) for distinct words."""
    w = words.select(F.col(word_col).alias("word")).distinct().where(F.length("word") > 0)
    return with_pieces(w, F.array("word"), vocab, whole=()).select("word", F.flatten("_pieces").alias("pieces"))


def word_pieces(df: DataFrame, ids: list[str], words: Column, vocab: DataFrame, pos: str = "pos",
                out: str = "token") -> DataFrame:
    """Rows 75/77: one row per piece: ``ids, pos`` (piece order in the line), ``token``."""
    cut = with_pieces(df, words, vocab, empty=True, keep=ids)  # an empty word stays as it is
    each = posexplode_rows(cut, ids, F.col("_pieces"), "_wp", "_p")
    p = posexplode_rows(each, [*ids, "_wp"], F.col("_p"), "_pp", out)
    return p.select(*ids, F.struct("_wp", "_pp").alias(pos), out)


def collect_ordered(rows: DataFrame, ids: list[str], pos: str, val: str, out: str) -> DataFrame:
    """Pieces back into an ordered array per row (one row's tokens: bounded by the row)."""
    return rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(pos, val))).alias("_a")) \
        .select(*ids, F.transform("_a", lambda x: x[val]).alias(out))


def tokenize_lines(df: DataFrame, ids: list[str], line_col: str, vocab: DataFrame | None,
                   preserve_whitespace: bool = True, tokenizer=None) -> DataFrame:
    """Row 75 per line: ``ids, tokens`` (array of word pieces; [] for a line without words).  ``tokenizer`` (row 105):
    a Column -> Column that gives the words; with ``vocab`` None these are the tokens, else they are cut into pieces."""
    line = F.col(line_col)
    words = tokenizer(line) if tokenizer is not None else code_words(line, preserve_whitespace)
    if vocab is None:
        return df.select(*ids, words.alias("tokens"))
    words = F.coalesce(words, F.array().cast("array<string>"))
    return with_pieces(df, words, vocab, empty=True, flat=True, keep=ids).select(*ids, F.col("_pieces").alias("tokens"))


def signature_pieces(df: DataFrame, ids: list[str], line_col: str, vocab: DataFrame, preserve_whitespace: bool = True,
                     tokenizer=None, flat: bool = False) -> DataFrame:
    """Row 76 word by word: ``ids, _pieces`` (array per word; with ``flat`` all pieces of the line).  Digits -> "0"; a word
    outside the vocabulary -> its signature (74), taken of each distinct word where that is cut; then word pieces."""
    line = F.col(line_col)
    words = tokenizer(line) if tokenizer is not None else signature_words(line, preserve_whitespace=preserve_whitespace)
    words = F.coalesce(words, F.array().cast("array<string>"))
    return with_pieces(df, words, vocab, whole=(), instead=(F.transform(words, token_signature), signature_of), flat=flat, keep=ids)


def signature_word_pieces(df: DataFrame, ids: list[str], line_col: str, vocab: DataFrame,
                          preserve_whitespace: bool = True, tokenizer=None) -> DataFrame:
    """Row 76 per line: ``ids, tokens``."""
    cut = signature_pieces(df, ids, line_col, vocab, preserve_whitespace, tokenizer, flat=True)
    return cut.select(*ids, F.col("_pieces").alias("tokens"))


def _places(told, tokens: str, unknown: int):
    """Each row's ids in place."""
    def run(batches):
        known = _vocabulary(*told)
        for b in batches:
            col = b.column(b.schema.get_field_index(tokens))
            flat = col.flatten().dictionary_encode(null_encoding="encode")
            found = pa.array(known.find_ids(flat.dictionary, unknown).astype(np.int32)).take(flat.indices)
            sizes = np.concatenate([[0], np.cumsum(np.diff(np.asarray(col.offsets)))]).astype(np.int32)
            keep = [i for i, n in enumerate(b.schema.names) if n != tokens]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.ListArray.from_arrays(pa.array(sizes), found)],
                                             [*(b.schema.names[i] for i in keep), "_ids"])
    return run


def _finder(told, tokens: str, unknown: int, more: str | None = None):
    """Adds each row's ids; ``more`` names a column with ids (token, i) of tokens that are not told."""
    def run(batches):
        ids = _head(*told)
        for b in batches:
            col = b.column(b.schema.get_field_index(tokens))
            flat = col.flatten().dictionary_encode()
            own = ids
            if more:  # equal tokens have equal ids in all rows
                told_here = b.column(b.schema.get_field_index(more)).flatten()
                own = ids | dict(zip(told_here.field("token").to_pylist(), told_here.field("i").to_pylist()))
            found = pa.array([int(own.get(t, unknown)) for t in flat.dictionary.to_pylist()], pa.int32()).take(flat.indices)
            sizes = np.concatenate([[0], np.cumsum(np.diff(np.asarray(col.offsets)))]).astype(np.int32)
            keep = [i for i, n in enumerate(b.schema.names) if n != tokens]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.ListArray.from_arrays(pa.array(sizes), found)],
                                             [*(b.schema.names[i] for i in keep), "_ids"])
    return run


def vocab_lookup(df: DataFrame, ids: list[str], tokens_col: str, vocab: DataFrame, out: str = "token_ids") -> DataFrame:
    """Row 30: tokens -> ids, unknown -> the [UNK] id; order kept.  In place for a vocabulary that every task can hold,
    by a join on the token for a larger one."""
    unk_id = vocab.where(F.col("token") == TOKEN_UNK).select("token_id").first()["token_id"]  # one scalar
    told = told_vocabulary(vocab)
    if told is not None:
        src = df.select(*ids, F.coalesce(tokens_col, F.array().cast("array<string>")).alias("_t"))
        fields = [f for f in src.schema.fields if f.name != "_t"]
        found = src.mapInArrow(_places(told, "_t", int(unk_id)), T.StructType([*fields, T.StructField("_ids", T.ArrayType(T.IntegerType()))]))
        return found.withColumnRenamed("_ids", out)
    src = df.select(*ids, F.coalesce(tokens_col, F.array().cast("array<string>")).alias("_t"))
    head = told_head(vocab)
    # a token of the head is a number where it is; the others of a line, each once, are joined
    got = cut_lineage(_with_left(src, "_t", head, frozenset(), "_t"))
    fields, number = [got.schema[c] for c in ids], T.StructField("_ids", T.ArrayType(T.IntegerType()))
    plain = got.where(F.size("_left") == 0).select(*ids, "_t").mapInArrow(_finder(head, "_t", int(unk_id)), T.StructType([*fields, number]))
    some = got.where(F.size("_left") > 0)
    asked = some.select("_row", F.explode(F.array_distinct("_left")).alias("token")).where(F.col("token").isNotNull())
    own = F.collect_list(F.struct("token", F.col("token_id").cast("int").alias("i")))
    of = asked.join(vocab.select("token", "token_id"), "token").groupBy("_row").agg(own.alias("_of"))
    both = some.join(of, "_row", "left").select(*ids, "_t", "_of").mapInArrow(
        _finder(head, "_t", int(unk_id), "_of"), T.StructType([*fields, T.StructField("_of", of.schema["_of"].dataType), number]))
    return plain.unionAll(both.drop("_of")).withColumnRenamed("_ids", out)


def cut_pair(a: Column, b: Column, seq_len: int) -> tuple[Column, Column]:
    """Two arrays of ids cut to ``seq_len - 3`` in all: from the longer side until both are equal, then from the second
    one first."""
    la, lb = F.size(a), F.size(b)
    over = F.greatest(la + lb - (seq_len - 3), F.lit(0))
    d = F.abs(la - lb)
    cut_a = F.when(over <= d, F.when(la > lb, over).otherwise(F.lit(0))).otherwise(
        F.when(la > lb, d).otherwise(F.lit(0)) + F.floor((over - d) / 2).cast("int"))
    return F.slice(a, 1, la - cut_a), F.slice(b, 1, lb - (over - cut_a))


def encode_ids(first_ids: Column, cls_id: int, sep_id: int, seq_len: int | None, second_ids: Column | None = None):
    """Row 78: ``[CLS] first [SEP] (second [SEP])``, truncated (longer side first) and
    zero-padded to ``seq_len``; returns (token_ids, segment_ids) columns."""
    a = first_ids
    if second_ids is None:
        if seq_len is not None:
            a = F.slice(a, 1, seq_len - 2)
        ids = F.concat(F.array(F.lit(cls_id)), a, F.array(F.lit(sep_id)))
        seg = F.array_repeat(F.lit(0), F.size(ids))
    else:
        b = second_ids
        if seq_len is not None:
            a, b = cut_pair(a, b, seq_len)
        ids = F.concat(F.array(F.lit(cls_id)), a, F.array(F.lit(sep_id)), b, F.array(F.lit(sep_id)))
        seg = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    if seq_len is not None:
        pad = F.greatest(F.lit(seq_len) - F.size(ids), F.lit(0))
        ids = F.concat(ids, F.array_repeat(F.lit(0), pad))
        seg = F.concat(seg, F.array_repeat(F.lit(0), pad))
    return ids, seg


def special_ids(vocab: DataFrame) -> dict:
    rows = vocab.where(F.col("token").isin(TOKEN_CLS, TOKEN_SEP, TOKEN_UNK, TOKEN_MASK)).collect()  # four rows
    return {r["token"]: int(r["token_id"]) for r in rows}
