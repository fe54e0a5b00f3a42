"""A vocabulary in a few flat arrays, for entries that are too many for a trie of objects.

Entries are kept as their UTF-8 bytes, one after the other, and are found by a 64-bit hash of these: a byte map tells
most strings that are none, a binary search finds the entry, and its bytes are compared, so results are exact whatever
the hash does.  An entry takes some 30 bytes besides its text.  Words are looked up and cut many at a time: hashes of
substrings follow from prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GOES_ON = b"##"
#: Slots of the byte map, as a power of two; bytes that are hashed at a time.
SLOTS, HASHED = 24, 1 << 20

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of every substring follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, len(data)), dtype=np.uint64, out=out[1:])
    return out


def _hash(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (sums[end] - sums[start]) * back[start]
    return h ^ (h >> np.uint64(32))  # high bits, which choose the slot, are the good ones; low ones get some of them


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings and where each one begins and the last one ends; a null is empty."""
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if strings.null_count:
        strings = strings.fill_null("")
    wide = strings.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each string, ``HASHED`` bytes or so at a time."""
    out, i = np.zeros(len(at) - 1, np.uint64), 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + HASHED, "right")) - 1)
        own = at[i:j + 1] - at[i]
        out[i:j] = _hash(_sums(data[at[i]:at[j]]), _power(_BACK, int(own[-1]) + 1), own[:-1], own[1:])
        i = j
    return out


class _Table:
    """Strings by hash."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray, rows: np.ndarray):
        # of equal strings the last one is found; strings that only share their hash stand next to each other
        order = np.argsort(own, kind="stable")[::-1]
        order = order[np.argsort(own[order], kind="stable")]
        self.data, self.hash = data, own[order]
        self.start, self.size, self.row = start[order], (end - start)[order].astype(np.int32), rows[order]
        self.map = np.zeros(1 << SLOTS, bool)
        self.map[self.hash >> np.uint64(64 - SLOTS)] = True
        same = np.diff(np.concatenate([[-1], np.flatnonzero(np.diff(self.hash)), [len(self.hash) - 1]])) if len(order) else np.zeros(0)
        self.most = int(same.max(initial=0))  # of one hash
        self.sizes = np.unique(self.size)[::-1]

    def find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each string, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.map[h >> np.uint64(64 - SLOTS)]) if len(self.hash) else np.zeros(0, np.int64)
        if not len(maybe):
            return out
        at = np.searchsorted(self.hash, h[maybe])
        for _ in range(self.most):
            on = at < len(self.hash)
            on[on] = self.hash[at[on]] == h[maybe[on]]
            maybe, at = maybe[on], at[on]
            if not len(maybe):
                break
            right = self._equal(at, data, start[maybe], size[maybe])
            out[maybe[right]] = self.row[at[right]]
            maybe, at = maybe[~right], at[~right] + 1
        return out

    def _equal(self, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = self.size[at] == size
        todo = np.flatnonzero(out)
        while len(todo):  # some bytes at a time
            n = max(1, int(np.searchsorted(np.cumsum(size[todo]), HASHED, "right")))
            some, todo = todo[:n], todo[n:]
            sizes = size[some].astype(np.int64)
            ends = np.cumsum(sizes)
            inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
            differs = data[np.repeat(start[some], sizes) + inside] != self.data[np.repeat(self.start[at[some]], sizes) + inside]
            out[some] = np.bincount(np.repeat(np.arange(len(some)), sizes)[differs], minlength=len(some)) == 0
        return out


class PackedVocabulary:
    def __init__(self, tokens: pa.Array, ids: np.ndarray | None = None):
        data, at = bytes_of(tokens)
        self.ids = ids
        rows = np.arange(len(tokens), dtype=np.int32)
        start, end = at[:-1], at[1:]
        own = hashes(data, at)
        full = np.flatnonzero(end > start)
        self.words = _Table(data, start[full], end[full], own[full], rows[full])
        self.none = rows[end == start]  # empty entries
        marked = np.flatnonzero(end - start > len(GOES_ON))
        marked = marked[(data[start[marked]] == GOES_ON[0]) & (data[start[marked] + 1] == GOES_ON[1])]
        # what goes on in a word, by itself
        rest = np.zeros(len(marked), np.uint64)
        for i in range(0, len(marked), 1 << 16):
            m = marked[i:i + (1 << 16)]
            lengths = end[m] - start[m] - len(GOES_ON)
            ends = np.cumsum(lengths)
            flat = np.repeat(start[m] + len(GOES_ON) - (ends - lengths), lengths) + np.arange(ends[-1])
            rest[i:i + (1 << 16)] = hashes(data[flat], np.concatenate([[0], ends]))
        self.rests = _Table(data, start[marked] + len(GOES_ON), end[marked], rest, rows[marked])

    def find(self, words: pa.Array) -> np.ndarray:
        """The entry of each word (its number), -1 for none or null."""
        data, at = bytes_of(words)
        out = self.words.find(hashes(data, at), data, at[:-1], np.diff(at))
        if len(self.none):
            out[at[1:] == at[:-1]] = self.none[-1]
        if words.null_count:
            out[words.is_null().to_numpy(zero_copy_only=False)] = -1
        return out

    def find_ids(self, words: pa.Array, unknown: int) -> np.ndarray:
        """The id of each word."""
        row = self.find(words)
        return np.where(row >= 0, self.ids[row], unknown) if len(self.ids) else np.full(len(row), unknown)

    def pieces(self, words: pa.Array) -> list[list[str]]:
        """The longest matches of each word, from its start; where none is, one character."""
        whole = self.find(words) >= 0
        texts = words.to_pylist()
        out = [[w] if k and w else [] for w, k in zip(texts, whole.tolist())]
        rest = np.flatnonzero(~whole)
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            for i, p in zip(some.tolist(), self._cut(words.take(pa.array(some)))):
                out[i] = p
        return out

    def _cut(self, words: pa.Array) -> list[list[str]]:
        data, at = bytes_of(words)
        best = np.zeros(len(data), np.int64)  # by first byte
        end = np.repeat(at[1:], np.diff(at))
        begins = (data & 0xC0) != 0x80
        first = np.zeros(len(data), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        sums, back = _sums(data), _power(_BACK, len(data) + 1)
        for table, places in ((self.words, np.flatnonzero(first)), (self.rests, np.flatnonzero(begins & ~first))):
            left = end[places] - places
            order = np.argsort(-left, kind="stable")
            places, left = places[order], left[order]
            for n in table.sizes[table.sizes <= (left[0] if len(left) else 0)].tolist():
                some = places[:np.searchsorted(-left, -n, "right")]
                some = some[best[some] == 0]
                if not len(some):
                    continue
                got = table.find(_hash(sums, back, some, some + n), data, some, np.full(len(some), n))
                best[some[got >= 0]] = n
        # no entry: the character that begins there
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        step, raw, out = np.where(best > 0, best, width).tolist(), data.tobytes(), []
        for b, e in zip(at[:-1].tolist(), at[1:].tolist()):
            own, p = [], b
            while p < e:
                n = p + step[p]
                own.append(("##" if p > b else "") + raw[p:n].decode())
                p = n
            out.append(own)
        return out
