"""Token ids in byte-aligned variable-length files with separate control bytes.

Ids are replaced by their frequency rank in the corpus, so frequent ids take one byte.  A block holds whole documents
in ascending doc_id order: one control byte for four values (two bits each: bytes - 1), then the values' bytes in
little-endian order.  Blocks are rows of a Parquet table (control and data as binary columns) under one folder, with
the table of ranks beside it: every file system that Spark writes to can hold them, and a lost task is written again.
A block names its range of documents and how many ids that range has before it, so blocks of equal documents are told
apart; the ids of earlier ranges, one row per range, are added when it is read.  Decoding looks the four lengths of each control byte up in a table and
gathers the bytes with numpy.

Defined results: null and empty texts are documents with the end id only; rows that share a doc_id are documents of
their own, in the order of their ids' crc32; a null doc_id comes first; an empty table gives an empty folder.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, release
from .common import LOWER, Chunk, chunks

END = 1
BLOCK_VALUES = 1 << 20
#: Words whose ids a worker keeps before it starts afresh; bounds its memory, not the result.
KEPT_WORDS = 3_000_000
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

#: How a file must normalise and split texts for them to be encoded word by word; others are encoded as whole texts.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
BLOCK_SCHEMA = "part int, inside long, n_values long, docs array<long>, lengths array<long>, control binary, data binary"

_loaded: dict = {}


def wordwise(told: dict) -> bool:
    """Whether a tokenizer's file says that texts are lower-cased and cut at white space and around punctuation."""
    first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (told.get("normalizer") == WORDWISE["normalizer"] and first.get("type") == "Split" and first.get("invert") is True
            and first.get("behavior") == "Removed" and (first.get("pattern") or {}).get("Regex") == WORDWISE["split"]
            and not any(a["normalized"] or not a["content"].startswith("<|") for a in told.get("added_tokens", [])))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    at = np.concatenate([[0], np.cumsum(code + 1, dtype=np.int64)])
    data = np.zeros(at[-1], np.uint8)
    for k in range(4):
        on = code >= k
        data[at[:-1][on] + k] = (v[on] >> np.uint32(8 * k)) & np.uint32(0xFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[:len(v)] = code
    four = four.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        on = lengths > k
        out[on] |= raw[(ends - lengths)[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Words:
    """A tokenizer and the ids of the words that this worker has met, as sorted hashes and one array of ids.

    With a file that is ``wordwise``, white space always separates words, so a text's ids are its words' ids one after
    the other; A-Z are lowered first (not in a chunk that may spell a special token), and stops after a letter or digit
    are a word of their own, as the pre-tokenizer makes them.  With any other file whole texts are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.wordwise = wordwise(json.loads(self.tokenizer.to_str()))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.start, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(n.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + len(flat), self.kind)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start = np.insert(self.start, at, (self.used + np.cumsum(n) - n).astype(np.int32))
        self.n = np.insert(self.n, at, n)
        self.used += len(flat)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's rows one after the other, and their number per row."""
        raw = c.data
        if not self.wordwise:
            text = raw.tobytes()
            ids = [e.ids for e in self.tokenizer.encode_batch([text[s:e].decode("utf-8", "replace") for s, e in zip(c.offs[:-1], c.offs[1:])],
                                                              add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(n.sum())), n
        if b"<|" not in raw.tobytes():
            c = Chunk(c.rows, LOWER[raw], c.offs)
        s, e, row = c.words()
        last = np.maximum.accumulate(np.where(_STOP[c.data], -1, np.arange(len(c.data))))
        body = np.maximum(last[e - 1] + 1, s) if len(s) else e
        cut = np.flatnonzero((body > s) & (body < e) & _ALNUM[c.data[body - 1]]) if len(s) else np.zeros(0, np.int64)
        s, e, row = np.insert(s, cut + 1, body[cut]), np.insert(e, cut, body[cut]), np.insert(row, cut, row[cut])
        found, first, which = np.unique(c.span_hashes(s, e), return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_WORDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != found if len(self.hashes) else np.ones(len(found), bool)
        if new.any():
            text = c.data.tobytes()
            self._learn(found[new], [text[s[i]:e[i]].decode("utf-8", "replace") for i in first[new].tolist()])
        at = np.searchsorted(self.hashes, found)[which] if len(found) else which
        n = self.n[at].astype(np.int64)
        place = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.start[at] - place, n) + np.arange(int(n.sum()))]
        return ids, np.bincount(row, n, c.n).astype(np.int64)


def _tokenizer(path: str) -> Words:
    """The words of this worker; the tokenizer's file is at the same path on every machine."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(path)
        last = np.array([end], words.kind).tobytes()
        for c in chunks(batches):
            flat, n = words.encode(c)
            at = np.concatenate([[0], np.cumsum(n)])
            ids = [flat[x:y].tobytes() + last for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                c.rows.column("doc_id"), pa.array(n + 1),
                pa.array([zlib.crc32(np.frombuffer(x, words.kind).astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "crc", "ids"])
    return run


def _counter(kind: str):
    def run(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                one = np.bincount(np.frombuffer(b"".join(b.column("ids").slice(at, 256).to_pylist()), kind))
                if len(one) > len(n):
                    one, n = n, one.astype(np.int64)
                n[:len(one)] += one
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], ["id", "n"])
    return run


def _blocks(kind: str, rank_of: np.ndarray):
    """Rows arrive in order; a block is cut after BLOCK_VALUES values, at the end of a document."""
    def block(inside, docs, lengths, parts):
        values = rank_of[np.frombuffer(b"".join(parts), kind)]
        control, data = pack(values)
        return pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([inside], pa.int64()), pa.array([len(values)], pa.int64()),
            pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([control], pa.binary()), pa.array([data], pa.binary())],
            ["part", "inside", "n_values", "docs", "lengths", "control", "data"])

    def run(batches):
        docs, lengths, parts, held, inside = [], [], [], 0, 0
        for b in batches:
            for d, n, ids in zip(*(b.column(k) for k in ("doc_id", "n_tokens", "ids"))):
                docs.append(d.as_py())
                lengths.append(n.as_py())
                parts.append(ids.as_buffer())
                held += lengths[-1]
                if held >= BLOCK_VALUES:
                    yield block(inside, docs, lengths, parts)
                    docs, lengths, parts, held, inside = [], [], [], 0, inside + held
        if docs:
            yield block(inside, docs, lengths, parts)
    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Encodes every whole text and writes blocks and ranks under ``path``."""
    spark = docs.sparkSession
    words = _tokenizer(tokenizer_path)
    kind, size = words.kind.str, max(words.tokenizer.get_vocab_size(), end + 1)
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoder(tokenizer_path, end), "doc_id long, n_tokens long, crc long, ids binary")
    # the row number lets equal documents be dealt over many ranges
    coded = cut_lineage(coded.withColumn("row_no", F.monotonically_increasing_id()))
    counts = coded.select("ids").mapInArrow(_counter(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    n = np.zeros(size, np.int64)
    for r in counts.collect():  # one row per id of the vocabulary
        n[r["id"]] = r["n"]
    order = np.lexsort((np.arange(size), -n))
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(path + "/ranks")
    order = ["doc_id", "crc", "row_no"]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_blocks(kind, rank_of), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path + "/blocks")
    release(coded)


def _reader(id_of: np.ndarray):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(c)[r] for c in ("offset", "n_values", "docs", "lengths", "control", "data")}
                ids = id_of[unpack(x["control"].as_buffer(), x["data"].as_buffer(), x["n_values"].as_py())]
                n = np.asarray(x["lengths"].values.to_numpy(), np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    x["docs"].values, pa.array(at[:-1] + x["offset"].as_py()), pa.array(n),
                    pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at[:-1], at[1:])], pa.int64()),
                    pa.array([raw[4 * s:4 * e] for s, e in zip(at[:-1], at[1:])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32 bit)."""
    ranks = spark.read.parquet(path + "/ranks").collect()  # one row per id of the vocabulary
    id_of = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path + "/blocks")
    ranges = blocks.groupBy("part").agg(F.sum("n_values").alias("n"))  # one row per range of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = blocks.join(F.broadcast(ranges), "part").select((F.col("earlier") + F.col("inside")).alias("offset"), "n_values", "docs",
                                                             "lengths", "control", "data")
    return placed.mapInArrow(_reader(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def fresh_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sightline-tables/ids-{uuid.uuid4().hex}"
