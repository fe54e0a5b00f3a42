"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every context (the word before, or the text's start) has a restaurant of its own, which seats the words that follow
it; every table sends a customer to the parent restaurant that all contexts share, and the parent's tables draw from
the uniform base over the training vocabulary and one unknown word.  In place of Gibbs moves of single customers, a
sweep draws the tables of each dish anew, customer after customer from an empty restaurant, given all others' table
counts; predictive probabilities are averaged over ``SAMPLES`` samples.

Spark's part: one pass cuts texts into events (word, context, document), pre-aggregated in batches of documents and
dealt by the hash of the word, so a word's counts, its seats in all restaurants and its place in the parent are
local to a task.  The totals of restaurants are exchanged for every sample: each part sends its own contexts' customers
and tables, dealt by the hash of the context and packed, to the task that sums them up, and gets the totals of just
these contexts back.  A last sweep-free pass scores the events where their counts are, and the documents' sums come
together by batch.  It is one plan: events are dealt once, and every step reads that exchange.

Defined results: null and empty texts are one end token; a null doc_id is a training document; rows that share a
doc_id are scored each; with no training text every token is unknown and scores the base; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Chunk, chunks, mix

#: Restaurants of ``Totals`` that no part has told anything.
CONTEXTS = 1 << 14
SAMPLES, SWEEPS = 2, 2
#: Discount and strength of the contexts and of their parent.
D1, S1, D0, S0 = 0.8, 2.0, 0.6, 10.0
#: Bytes of text whose events one task holds; tokens and documents of a batch of events.
PART_BYTES = 16 << 20
BATCH_TOKENS, BATCH_DOCS = 1_000_000, 60_000
SMALL_BYTES = 1 << 14
END, START = np.uint64(0x5EED_0F_E2D), np.uint64(0x5EED_0F_57A27)
_CODEC = "zstd"
EVENTS = ("place int, part int, batch long, words long, contexts long, events long, n_train long, n_docs long, tokens long, "
          "blob binary")
TOTALS = ("place int, part int, sample int, n long, tokens long, vocabulary long, parent_tables long, all_tables long, "
          "blob binary")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays packed by planes of bytes, large ones each by itself; ascending 64-bit hashes as differences."""
    planes = []
    for a in arrays:
        if a.dtype == np.uint64:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes += [x.tobytes() for x in np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T]
    if sum(map(len, planes)) < SMALL_BYTES:
        planes = [b"".join(planes)]
    packed = (pa.compress(x, _CODEC, asbytes=True) for x in planes)
    return b"".join(len(x).to_bytes(4, "little") + x for x in packed)


def _spread(blob, *kinds: tuple[int, str]) -> list[np.ndarray]:
    blob, at = memoryview(blob), 0

    def unpacked(n):
        nonlocal at
        size = int.from_bytes(blob[at:at + 4], "little")
        at += 4 + size
        return np.frombuffer(pa.decompress(blob[at - size:at], n, _CODEC) if n else b"", np.uint8)
    kinds = [(n, np.dtype(kind)) for n, kind in kinds]
    n_bytes = sum(n * kind.itemsize for n, kind in kinds)
    small, done = (unpacked(n_bytes), 0) if n_bytes < SMALL_BYTES else (None, 0)
    out = []
    for n, kind in kinds:
        planes = np.empty((n, kind.itemsize), np.uint8)
        for i in range(kind.itemsize):
            planes[:, i] = unpacked(n) if small is None else small[done:done + n]
            done += n
        a = planes.reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=kind) if kind == np.uint64 else a)
    return out


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse, in half the memory."""
    order = np.argsort(a)
    a = a[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    a = a[new]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return a, which


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, hash of the context (the word before) and row of every token, an end after each row's words."""
    starts, ends, doc = c.words()
    n = c.per_row(doc)
    w = np.full(len(doc) + c.n, END, np.uint64)
    w[np.arange(len(doc)) + doc] = c.span_hashes(starts, ends)
    row = np.repeat(np.arange(c.n), n + 1)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[np.cumsum(n + 1) - n - 1] = START
    return w, before, row


def _index_kind(n: int) -> str:
    return "u2" if n <= 1 << 16 else "u4"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, fields)], names=[name for name, _ in fields])


def _joined(pieces: list) -> np.ndarray:
    whole = np.concatenate(pieces)
    pieces.clear()  # the caller is done with them
    return whole


def _events(places: np.ndarray):
    parts = len(places)

    def flush(batch, ids, train, sizes, w, k, d):
        ids, train, sizes = (np.concatenate(x) for x in (ids, train, sizes))
        w, k, d = (_joined(x) for x in (w, k, d))
        order = np.argsort(~train, kind="stable")  # training documents first
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order))
        words, which = _distinct(w)
        part = ((mix(words + np.uint64(1)) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        rank = np.empty(len(words), np.uint64)
        rank[by_part] = np.arange(len(words))
        contexts, k = _distinct(k)
        n_k, n_d = np.uint64(len(contexts)), np.uint64(len(ids))
        key, n = np.unique((rank[which] * n_k + k.astype(np.uint64)) * n_d + place[d], return_counts=True)
        more = -(-n // 255)  # counts of a byte; the few larger ones take several events
        rest = n - 255 * (more - 1)
        key = np.repeat(key, more)
        count = np.full(len(key), 255, np.uint8)
        count[np.cumsum(more) - 1] = rest
        pair, d = key // n_d, (key % n_d).astype(np.uint16)
        word, k = (pair // n_k).astype(np.int64), (pair % n_k).astype(np.int64)
        per_word = np.bincount(word, minlength=len(words))
        word_at = np.concatenate([[0], np.cumsum(per_word)])
        cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
        seen, index = np.zeros(len(contexts), bool), np.zeros(len(contexts), np.uint32)
        home = int(places[(batch + (batch >> 32)) % parts])
        rows = [(home, -1, batch, 0, 0, 0, int(train.sum()), len(ids), 0, _squeeze(ids[order], sizes[order]))]
        for p in range(parts):
            s, e = cuts[p], cuts[p + 1]
            x, y = word_at[s], word_at[e]
            if e > s:
                seen[k[x:y]] = True
                own = np.flatnonzero(seen)
                index[own] = np.arange(len(own))
                seen[own] = False
                rows.append((int(places[p]), p, batch, int(e - s), len(own), int(y - x), int(train.sum()), len(ids), 0, _squeeze(
                    words[by_part[s:e]], contexts[own], per_word[s:e].astype(np.uint32),
                    np.diff(index[k[x:y]], prepend=np.uint32(0)).astype(_index_kind(len(own))), d[x:y], count[x:y])))
        return _table(rows, EVENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        batch = TaskContext.get().partitionId() << 32
        held, n, docs = [[] for _ in range(6)], 0, 0
        for c in chunks(batches, lower=True):
            w, k, row = tokens(c)
            ids = c.rows.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            train = ~c.rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            if docs and (docs + c.n > BATCH_DOCS or n + len(w) > BATCH_TOKENS):
                yield from flush(batch, *held).to_batches()
                batch, held, n, docs = batch + 1, [[] for _ in range(6)], 0, 0
            for x, y in zip(held, (ids, train, np.bincount(row, minlength=c.n).astype(np.int64), w, k, row + docs)):
                x.append(y)
            n, docs = n + len(w), docs + c.n
        if docs:
            yield from flush(batch, *held).to_batches()
    return run


def _batch_events(row: tuple) -> tuple:
    """Words and contexts of one batch's events in a part, word and context of every distinct pair, and pair, document and
    times of every event; events come sorted by pair."""
    n_words, n_contexts, n_events, _, _, blob = row
    words, contexts, per, k, doc, times = _spread(blob, (n_words, "u8"), (n_contexts, "u8"), (n_words, "u4"),
                                                  (n_events, _index_kind(n_contexts)), (n_events, "u2"), (n_events, "u1"))
    k = np.cumsum(k, dtype=k.dtype)  # differences, small within a frequent word
    word = np.repeat(np.arange(n_words, dtype=np.int32), per)
    new = np.ones(n_events, bool)
    new[1:] = (word[1:] != word[:-1]) | (k[1:] != k[:-1])
    return words, contexts, word[new], k[new], np.cumsum(new, dtype=np.int32) - 1, doc, times


class Part:
    """The words of one part: for every distinct (word, restaurant) its training count, and for every batch where its own
    pairs are among them; events are read again where they are scored.  ``contexts`` names the restaurants, in ascending
    order."""

    def __init__(self, rows: list):
        self.rows = rows
        words, word, contexts, k, count = [], [], [], [], []
        n_w = n_k = 0
        for row in rows:
            u, c, w, x, pair, doc, times = _batch_events(row)
            words.append(u)
            contexts.append(c)
            word.append(w + np.int32(n_w))
            k.append((x + np.int64(n_k)).astype(np.int32))
            count.append(np.bincount(pair, times * (doc < row[3]), len(w)).astype(np.int32))
            n_w, n_k = n_w + len(u), n_k + len(c)
        ends = np.cumsum([len(w) for w in word])
        words, same = _distinct(np.concatenate(words))
        self.n_words = len(words)
        key = same[np.concatenate(word)].astype(np.int64)
        del words, word
        self.contexts, same = _distinct(np.concatenate(contexts))
        key *= len(self.contexts)
        key += same[np.concatenate(k)]
        del contexts, k, same
        key, pair = _distinct(key)
        self.pairs = np.split(pair, ends[:-1])
        self.word, self.k = key // len(self.contexts), key % len(self.contexts)
        self.count = np.bincount(pair, np.concatenate(count), len(key)).astype(np.int64)
        self.of_word = np.bincount(self.word, self.count, self.n_words).astype(np.int64)


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of a dish after ``count`` customers sat down one by one, each opening a table with probability
    new / (new + customers - discount * tables).  Beyond 32 customers they come in parties of a quarter of those
    seated, with the odds at the party's middle."""
    tables = np.minimum(count, 1)
    on = np.flatnonzero(count > 1)
    n = 1
    while len(on):
        party = max(1, n // 4) if n >= 32 else 1
        size = np.minimum(count[on] - n, party)
        a = new[on]
        p = a / (a + n + (size - 1) / 2 - discount * tables[on])
        tables[on] += (rng.random(len(on)) < p) if party == 1 else rng.binomial(size, np.clip(p, 0, 1))
        n += party
        on = on[count[on] > n]
    return tables


class Totals:
    """What a part is told of all parts: customers and tables of its contexts, in their order, the tables of all contexts
    and of the parent, and the training text.  Told nothing, ``all_tables`` are those it holds."""

    def __init__(self, rows: list):
        self.customers, self.tables = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
        self.tokens = self.vocabulary = self.parent_tables = 0
        self._all_tables = None
        if rows:  # one of every task that sums up totals, in order of its hashes
            self.tokens, self.vocabulary, self.parent_tables, self._all_tables = rows[0][1:5]
            told = [_spread(blob, (n, "i8"), (n, "i8")) for n, *_, blob in rows]
            self.customers, self.tables = (np.concatenate(x).astype(float) for x in zip(*told))

    @property
    def all_tables(self):
        return self.tables.sum() if self._all_tables is None else self._all_tables


def sample(part: Part, totals: Totals, seed: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of every (word, context), and of every word its customers and tables in the parent, after ``SWEEPS``
    sweeps given the totals of the sample before.  The same seed gives the same seats."""
    rng = np.random.default_rng(seed)
    seated = part.count > 0
    tables = seated.astype(np.int64)
    parent = np.bincount(part.word, tables, part.n_words).astype(np.int64)
    own = np.minimum(parent, 1)
    for _ in range(SWEEPS):
        p0 = parent_probability(parent, own, totals)
        tables = seat(part.count, (S1 + D1 * totals.tables[part.k]) * p0[part.word], D1, rng)
        parent = np.bincount(part.word, tables, part.n_words).astype(np.int64)
        own = seat(parent, np.full(part.n_words, (S0 + D0 * totals.parent_tables) / (totals.vocabulary + 1)), D0, rng)
    return tables, parent, own


def parent_probability(parent, own, totals: Totals) -> np.ndarray:
    base = (S0 + D0 * totals.parent_tables) / (totals.vocabulary + 1)
    return (parent - D0 * own + base) / (S0 + totals.all_tables)


def probability(part: Part, seats, totals: Totals) -> np.ndarray:
    """Predictive probability of every (word, context) given one sample and its totals."""
    tables, parent, own = seats
    p0 = parent_probability(parent, own, totals)[part.word]
    return (part.count - D1 * tables + (S1 + D1 * totals.tables[part.k]) * p0) / (S1 + totals.customers[part.k])


def _sorted(rows: pa.Table, by: str, *columns: str) -> list[tuple]:
    """Values of the columns and the blob, not copied, of every row in order."""
    order = np.argsort(rows[by].to_numpy())
    cols, blobs = [rows[c].to_numpy() for c in columns], [x.as_buffer() for x in rows["blob"]]
    return [(*(int(c[i]) for c in cols), blobs[i]) for i in order]


def _part(events: pa.Table) -> tuple[int, Part | None, list]:
    """The part whose events a task holds, and their batches in order."""
    rows = [x for x in _sorted(events, "batch", "part", "batch", "words", "contexts", "events", "n_train", "n_docs") if x[0] >= 0]
    return (rows[0][0], Part([x[2:] for x in rows]), [x[1] for x in rows]) if rows else (-1, None, [])


def _told(totals: pa.Table, sample: int) -> Totals:
    rows = _sorted(totals, "part", "sample", "n", "tokens", "vocabulary", "parent_tables", "all_tables")
    return Totals([x[1:] for x in rows if x[0] == sample])


def _tell(places: np.ndarray, number: int, seed: int):
    """Customers and tables that a part's words have in its contexts, dealt by context: of the counts at first, then of
    the next sample given the totals before."""
    def run(events, before=None):
        p, part, _ = _part(events)
        if part is None:
            return _table([], TOTALS)
        if before is not None:
            tables, _, own = sample(part, _told(before, number - 1), (seed, number, p))
        else:
            tables, own = (part.count > 0).astype(np.int64), (part.of_word > 0).astype(np.int64)
        n = len(part.contexts)
        x, y = (np.bincount(part.k, v, n).astype(np.int64) for v in (part.count, tables))
        of_all = int(part.of_word.sum()), int((part.of_word > 0).sum()), int(own.sum()), int(tables.sum())
        home = (part.contexts >> np.uint64(32)) * np.uint64(len(places)) >> np.uint64(32)  # ascending, as the contexts are
        cuts = np.searchsorted(home, np.arange(len(places) + 1).astype(np.uint64))
        return _table([(int(to), p, number, int(e - s), *of_all, _squeeze(part.contexts[s:e], x[s:e], y[s:e]))
                       for to, s, e in zip(places, cuts, cuts[1:])], TOTALS)
    return run if number else lambda events: run(events)  # Spark passes a key to what takes two


def _sum_up(places: np.ndarray):
    """Totals of the contexts that are summed up here, told to every part that holds them."""
    def run(told):
        here = int(np.flatnonzero(places == told["place"][0].as_py())[0])
        n = told["n"].to_pylist()
        got = [_spread(x.as_buffer(), (k, "u8"), (k, "i8"), (k, "i8")) for k, x in zip(n, told["blob"])]
        contexts, x, y = (np.concatenate(v) for v in zip(*got))
        contexts, same = np.unique(contexts, return_inverse=True)
        x, y = (np.bincount(same, v, len(contexts)).astype(np.int64)[same] for v in (x, y))
        of_all = [pc.sum(told[c]).as_py() for c in ("tokens", "vocabulary", "parent_tables", "all_tables")]
        ends = np.cumsum(n)
        return _table([(int(places[p]), here, number, k, *of_all, _squeeze(x[e - k:e], y[e - k:e]))
                       for p, number, k, e in zip(told["part"].to_pylist(), told["sample"].to_pylist(), n, ends)], TOTALS)
    return run


def _score(seed: int):
    """The sums of each document over the words of a part; rows of documents pass."""
    def run(events, totals):
        documents = events.filter(pc.equal(events["part"], -1))
        p, part, ids = _part(events)
        if part is None:
            return documents
        samples = [_told(totals, i) for i in range(SAMPLES + 1)]
        seats = [sample(part, samples[i], (seed, i + 1, p)) for i in range(SAMPLES)]
        log_p = np.log10(sum(probability(part, s, t) for s, t in zip(seats, samples[1:])) / SAMPLES)
        own = part.of_word[part.word]
        base = np.log10((own + 0.5) / (samples[0].tokens + 0.5 * (samples[0].vocabulary + 1)))
        known = own > 0
        rows = []
        for batch, row, pairs in zip(ids, part.rows, part.pairs):
            *_, pair, doc, times = _batch_events(row)
            n = row[4]
            on = np.flatnonzero(np.bincount(doc, minlength=n))
            sums = [np.bincount(doc, times * v[pairs][pair], n)[on] for v in (log_p, base, known)]
            rows.append((0, p, batch, 0, 0, len(on), 0, n, samples[0].tokens, _squeeze(
                on.astype(np.uint16), sums[0], sums[1], sums[2].astype(np.uint32))))
        return pa.concat_tables([documents.cast(_table([], EVENTS).schema), _table(rows, EVENTS)])
    return run


def _gather(batches):
    """Documents of each batch with the sums of all parts; rows arrive sorted by batch, the documents' row first."""
    now, ids, sizes, n_train, n_tokens, sums = None, None, None, 0, 0, None

    def told():
        return pa.RecordBatch.from_arrays([
            pa.array(ids, mask=ids == -(1 << 63)), pa.array(np.arange(len(ids)) >= n_train), pa.array(sizes),
            pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(np.full(len(ids), n_tokens)), pa.array(sums[1]), pa.array(sums[0])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    for b in batches:
        for i in range(b.num_rows):
            batch, n, events = (b.column(c)[i].as_py() for c in ("batch", "n_docs", "events"))
            blob = b.column("blob")[i].as_buffer()
            if b.column("part")[i].as_py() < 0:
                if now is not None:
                    yield told()
                now, n_train, sums = batch, b.column("n_train")[i].as_py(), np.zeros((3, n))
                ids, sizes = _spread(blob, (n, "i8"), (n, "i8"))
            else:
                n_tokens = b.column("tokens")[i].as_py()
                on, x, y, z = _spread(blob, (events, "u2"), (events, "f8"), (events, "f8"), (events, "u4"))
                sums[0][on] += x
                sums[1][on] += y
                sums[2][on] += z
    if now is not None:
        yield told()


def _places(spark, parts: int) -> np.ndarray:
    """A number for each part, of which no two fall into one of ``parts`` hash partitions (all parts, but for a chance of
    e^-20)."""
    numbers = spark.range(int(parts * (np.log(parts) + 20))).select(F.col("id").cast("int").alias("place"))
    found = numbers.groupBy(F.pmod(F.hash("place"), F.lit(parts)).alias("slot")).agg(F.min("place").alias("place"))
    return np.array(sorted(r["place"] for r in found.collect()), np.int32)  # one row per part


def score(docs: DataFrame, seed: int = 11) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's
    probability of the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = _places(docs.sparkSession, int(max(1, -(-n_bytes // PART_BYTES))))

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(len(places), "place")

    # the documents' rows go beside the events, dealt by batch
    events = deal(rows.mapInArrow(_events(places), EVENTS)).groupBy("place")
    totals: list[DataFrame] = []
    for i in range(SAMPLES + 1):
        if totals:
            told = events.cogroup(deal(totals[-1]).groupBy("place")).applyInArrow(_tell(places, i, seed), TOTALS)
        else:
            told = events.applyInArrow(_tell(places, 0, seed), TOTALS)
        totals.append(deal(told).groupBy("place").applyInArrow(_sum_up(places), TOTALS))
    told = deal(reduce(DataFrame.unionAll, totals)).groupBy("place")
    scored = events.cogroup(told).applyInArrow(_score(seed), EVENTS)
    return cut_lineage(scored.repartition("batch").sortWithinPartitions("batch", "part").mapInArrow(
        _gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
