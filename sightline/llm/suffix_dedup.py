"""Removal of repeated byte strings with blockwise suffix arrays and a difference cover.

Every window of LENGTH bytes belongs to the suffix bucket named by the smallest hash of its GRAM-byte substrings, so
equal windows are always in one bucket.  A run of windows of one bucket (a piece) travels as one row.  Pieces that
are equal as a whole need no sorting: all but the first are repeats.  Different pieces of one bucket travel with their
bytes, and a task sorts one block of buckets at a time: suffixes are ordered by their first bytes, and long ties are
resolved by the ranks of the difference cover's sample, computed before for that block by doubling.  Neighbours in
that order that agree in LENGTH bytes are one class; all but its earliest window are repeats.

A bucket whose different pieces exceed BUCKET_BYTES is given up: its windows alone are cut again, named by the smallest
hash of longer substrings, and at last by the hash of the whole window, where only equal windows meet.  Equal windows
get equal names at every level.  So a block's memory is a small multiple of BLOCK_BYTES + BUCKET_BYTES.

Defined results: null counts as empty; texts below LENGTH bytes lose nothing; rows that share a doc_id (or have none)
are documents of their own, in the order of doc_id (null first), text hash, row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import cut_lineage
from .common import Chunk, chunks, has_unique_ids

LENGTH = 100
GRAM = 30
#: A perfect difference set: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20

_IN = np.isin(np.arange(PERIOD), COVER)
#: SHIFT[a, b]: the least shift that takes positions of residues a and b into the cover together.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD]) for b in range(PERIOD)]
                  for a in range(PERIOD)])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(h)
    pad = np.full(-n % width, np.iinfo(h.dtype).max, h.dtype)
    blocks = np.concatenate([h, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def grams(length: int, gram: int) -> list[int]:
    """Bytes of the substrings that name the buckets of each level."""
    return [gram, (gram + length) // 2, length]


def smallest(c: Chunk, length: int, gram: int) -> np.ndarray:
    """Smallest hash of the substrings of every window."""
    at = np.arange(len(c.data) - gram + 1)
    return sliding_min(c.span_hashes(at, at + gram), length - gram + 1)


def pieces(c: Chunk, length: int, gram: int, hot: list[np.ndarray] = ()):
    """Bucket, hash, row, start, windows and self (may repeat inside itself) of the pieces of a chunk's rows, at the level
    after those of ``hot``: the sorted names of the buckets that each level gave up, whose windows alone are cut."""
    none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    if len(c.data) < length:
        return none
    left = None
    for names, g in zip(hot, grams(length, gram)):
        in_hot = np.isin(smallest(c, length, g), names)
        left = in_hot if left is None else left & in_hot
    if left is not None and not left.any():
        return none
    gram = grams(length, gram)[len(hot)]
    width = length - gram + 1
    at = np.arange(len(c.data) - gram + 1)
    low = smallest(c, length, gram)
    h = c.span_hashes(at, at + gram)
    row = np.repeat(np.arange(c.n), np.diff(c.offs))
    whole = row[:len(low)] == row[length - 1:]  # windows that stay in a row
    if left is not None:
        whole &= left
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (row[1:len(low)] != row[:len(low) - 1])
    start = np.flatnonzero(new)
    if not len(start):
        return none
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    end = np.flatnonzero(stop) + 1
    inside = np.arange(width)
    first, last = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    for s in range(0, len(start), 1 << 14):
        e = s + (1 << 14)
        first[s:e] = start[s:e] + np.argmax(h[start[s:e, None] + inside] == low[start[s:e], None], 1)
        last[s:e] = end[s:e] - 1 + width - 1 - np.argmax(h[end[s:e, None] - 1 + inside[::-1]] == low[start[s:e], None], 1)
    return (low[start], c.span_hashes(start, end + length - 1), row[start], start - c.offs[row[start]], end - start, first != last)


def _cut(length: int, gram: int, hot: list[np.ndarray]):
    """Pieces of all texts.  Of equal pieces in a chunk only the first can be the first of its kind: the others are told
    (a negative ``n2``), so a passage that very many documents share sends one row per chunk to its bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            bucket, same, row, start, n, self_ = pieces(c, length, gram, hot)
            doc = c.rows.column("doc").to_numpy()[row]
            n2 = (n.astype(np.int32) << 1) | self_
            order = np.lexsort((start, doc, same, bucket))
            again = order[1:][(same[order][1:] == same[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])]
            n2[again] = -n2[again]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(same.view(np.int64)), pa.array(doc),
                                              pa.array(start.astype(np.int32)), pa.array(n2.astype(np.int32))],
                                             ["bucket", "same", "doc", "start", "n2"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (bucket, same, doc, start), those told already anywhere between.  Repeats of a piece are told as such (open false); the first of
    its kind is told (open true) when its bucket has other kinds or the piece may repeat inside itself."""
    held = None  # the first row of the running kind, told or not yet
    for b in batches:
        if not b.num_rows:
            continue
        x = {k: b.column(k).to_numpy() for k in ("bucket", "same", "doc", "start", "n2")}
        told_before = x["n2"] < 0
        if told_before.any():
            yield _hits({k: np.abs(v[told_before]) if k == "n2" else v[told_before] for k, v in x.items()}, np.arange(int(told_before.sum())),
                        np.zeros(int(told_before.sum()), bool))
            x = {k: v[~told_before] for k, v in x.items()}
            if not len(x["doc"]):
                continue
        if held is not None:
            x = {k: np.concatenate([held[0][k], x[k]]) for k in x}
        n = len(x["doc"])
        bucket_new = np.ones(n, bool)
        bucket_new[1:] = x["bucket"][1:] != x["bucket"][:-1]
        kind_new = bucket_new.copy()
        kind_new[1:] |= x["same"][1:] != x["same"][:-1]
        of = np.cumsum(bucket_new) - 1
        kinds = np.bincount(of, kind_new)
        many = (kinds > 1)[of]
        told = np.zeros(n, bool)
        if held is not None:  # row 0 was seen before
            told[0] = held[1]
            many[of == 0] |= held[2]
        open_ = kind_new & (many | (x["n2"] & 1).astype(bool))
        # the last kind's first row waits: its bucket may go on
        last = int(np.flatnonzero(kind_new)[-1])
        tell = (open_ | ~kind_new) & ~told
        out = np.flatnonzero(tell)
        yield _hits(x, out, kind_new)
        held = ({k: v[last:last + 1].copy() for k, v in x.items()}, bool(told[last] or tell[last]), bool(many[last]))


def _hits(x, out, kind_new):
    return pa.RecordBatch.from_arrays([pa.array(x["bucket"][out]), pa.array(x["doc"][out]), pa.array(x["start"][out]),
                                       pa.array((x["n2"][out] >> 1).astype(np.int32)), pa.array(kind_new[out])],
                                      ["bucket", "doc", "start", "n", "open"])


def _fetch(length: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column("text")[i].as_buffer()
                want = b.column("want")[i].values
                bucket, start, n = (want.field(k).to_numpy() for k in range(3))
                raw = bytes(raw)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), pa.array(np.full(len(bucket), b.column("doc")[i].as_py(), np.int64)), pa.array(start), pa.array(n),
                    pa.array([raw[s:s + k + length - 1] for s, k in zip(start.tolist(), n.tolist())], pa.binary())],
                    ["bucket", "doc", "start", "n", "bytes"])
    return run


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
    return rank


def classes(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Among the windows of ``length`` bytes at ``at``: those that equal another, and a class number for each."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(2 * length + 16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 2 * length, np.uint64)  # eight bytes from each position, most significant first
    for k in range(8):
        word = word << np.uint64(8) | pad[k:k + len(word)]
    # suffixes by their first 16 bytes; those alone in them are done
    a, b = word[at], word[at + 8]
    order = np.lexsort((b, a))
    a, b, at = a[order], b[order], at[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    group = np.cumsum(np.concatenate([[True], ~same])).astype(np.int64)[tied]
    at = at[tied]
    if not len(at):
        return at, at
    # ranks of the cover's sample by PERIOD bytes, then doubled until they span a window
    sample = np.flatnonzero(_IN[np.arange(n + PERIOD) % PERIOD])
    place = np.full(n + 4 * length, len(sample), np.int64)
    place[sample] = np.arange(len(sample))
    head = _dense(word[sample])
    tail = _dense(word[sample + 8] >> np.uint64(8 * (16 - PERIOD)))
    rank, span = np.append(_dense(head * (tail.max() + 1) + tail), 0), PERIOD
    while span < length:
        then = rank[place[sample + span]]
        rank, span = np.append(_dense(rank[:-1] * (then.max() + 1) + then), 0), 2 * span
    # each residue's suffixes in order, then merged: how many of each other residue come before
    residue = at % PERIOD
    rows = []
    for r in range(PERIOD):
        own = np.flatnonzero(residue == r)
        own = own[np.lexsort((rank[place[at[own] + SHIFT[r, r]]], group[own]))]
        rows.append(own)
    step = np.int64(rank.max() + 1)
    where = np.empty(len(at), np.int64)
    for r, own in enumerate(rows):
        total = np.arange(len(own))
        for q, other in enumerate(rows):
            if q != r and len(own) and len(other):
                d = SHIFT[r, q]
                total = total + np.searchsorted(group[other] * step + rank[place[at[other] + d]],
                                                group[own] * step + rank[place[at[own] + d]], "right" if q < r else "left")
        where[own] = total
    order = np.argsort(where, kind="stable")
    at, group = at[order], group[order]
    equal = np.flatnonzero(group[1:] == group[:-1])  # neighbours that agree in the whole window
    for k in [*range(16, length - 8, 8), length - 8]:
        equal = equal[word[at[equal] + k] == word[at[equal + 1] + k]]
    joined = np.zeros(len(at), bool)
    joined[equal + 1] = True
    number = np.cumsum(~joined)
    some = joined.copy()
    some[:-1] |= joined[1:]
    return at[some], number[some]


def block_repeats(bucket, doc, start, n, raw: list[bytes], length: int):
    """(doc, start, n) runs of windows of these pieces that an earlier window equals.  Classes may only join windows of
    one bucket: equal windows have equal buckets."""
    sizes = np.array([len(x) for x in raw])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(raw), np.uint8)
    piece = np.repeat(np.arange(len(raw)), n)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = offs[piece] + inside
    got, number = classes(text, at, length)
    own = np.searchsorted(offs, got, "right") - 1
    pos = start[own] + (got - offs[own])
    order = np.lexsort((pos, doc[own], number))
    later = np.concatenate([[False], number[order][1:] == number[order][:-1]]) if len(order) else np.zeros(0, bool)
    hit = order[later]
    hit = hit[np.lexsort((pos[hit], own[hit]))]
    own, pos = own[hit], pos[hit]
    if not len(own):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + 1)])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(own))
    return doc[own[s]], pos[s], pos[e - 1] - pos[s] + 1


def _sort_blocks(length: int):
    names = ["bucket", "doc", "start", "n"]

    def told(t: pa.Table):
        x = {k: t.column(k).to_numpy() for k in names}
        doc, start, n = block_repeats(*(x[k].astype(np.int64) for k in names), t.column("bytes").to_pylist(), length)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "start", "n"])

    def run(batches):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                t = pa.Table.from_batches([b.slice(at, 1024)])
                held = t if held is None else pa.concat_tables([held, t])
                if held.nbytes >= BLOCK_BYTES:  # a block ends where a bucket ends
                    bucket = held.column("bucket").to_numpy()
                    ends = np.flatnonzero(bucket != bucket[-1])
                    if len(ends):
                        cut = int(ends[-1]) + 1
                        yield told(held.slice(0, cut))
                        held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield told(held)
    return run


def _strip(length: int):
    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                raw = bytes(b.column("text")[i].as_buffer())
                gone = b.column("gone")[i]
                if not gone.is_valid or not len(gone):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                start, n = (gone.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                mark = np.zeros(len(raw) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + n + length - 1, -1)
                cover = np.cumsum(mark)[:-1] > 0
                spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                out.append((len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): ``doc`` orders the documents.  It is the doc_id itself where ids are unique; else the place
    in the order of (doc_id, text hash, row)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if has_unique_ids(own):
        return own.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    marked = cut_lineage(own.withColumn("row_no", F.monotonically_increasing_id()))
    keys = marked.select("row_no", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"))
    place = cut_lineage(dense_index(keys, [F.col("d"), F.col("h"), F.col("row_no")], "doc").select("row_no", "doc"))
    return marked.join(place, "row_no").select("doc", "doc_id", "text")


def bucket_hits(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The pieces told by ``_meet``, in buckets of at most ``BUCKET_BYTES`` of open pieces; only at the last level, where
    a name is a window's own hash, more could be open (runs of one byte, one of each length)."""
    out, hot = None, []
    levels = len(grams(length, gram))
    rows = texts.select("doc", "text").where(F.octet_length("text") >= length)
    while True:
        cut = rows.mapInArrow(_cut(length, gram, hot), "bucket long, same long, doc long, start int, n2 int")
        place = F.when(F.col("n2") < 0, F.xxhash64("doc", "start")).otherwise(F.col("bucket"))
        hits = cut.repartition(place).sortWithinPartitions("bucket", "same", "doc", "start")
        hits = cut_lineage(hits.mapInArrow(_meet, "bucket long, doc long, start int, n int, open boolean"))
        big = hits.where("open").groupBy("bucket").agg(F.sum(F.col("n") + length - 1).alias("bytes")).where(F.col("bytes") > BUCKET_BYTES)
        names = [r["bucket"] for r in big.select("bucket").collect()] if len(hot) < levels - 1 else []  # one per BUCKET_BYTES at most
        if names:
            given_up = F.broadcast(texts.sparkSession.createDataFrame([(x,) for x in names], "bucket long"))
            kept = hits.join(given_up, "bucket", "left_anti")
        else:
            kept = hits
        out = kept if out is None else out.unionAll(kept)
        if not names:
            return out
        hot = [*hot, np.sort(np.array(names, np.int64).view(np.uint64))]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after every byte is removed that a string
    of ``length`` bytes covers which also starts earlier."""
    if not 2 * PERIOD <= length or not 0 < gram <= length:
        raise ValueError("length must be at least two periods of the cover, and gram at most length")
    texts = numbered(docs)
    hits = bucket_hits(texts, length, gram)
    want = hits.where("open").groupBy("doc").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("want"))
    opened = texts.select("doc", "text").join(want, "doc").mapInArrow(
        _fetch(length), "bucket long, doc long, start int, n int, bytes binary")
    found = opened.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks(length), "doc long, start int, n int")
    gone = hits.where("NOT open").select("doc", "start", "n").unionAll(found)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    out = texts.join(gone, "doc", "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_strip(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
