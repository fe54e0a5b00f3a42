"""Unigram encoding and decoding with the pieces of a SentencePiece model file.

An Aho-Corasick automaton over the pieces reports, following output links, every piece that ends at a position; one
pass over them relaxes the best score of each position (Viterbi), and the back pointers give the pieces.  Characters
that no piece covers become their UTF-8 byte pieces, at a score below every segmentation by pieces.

Spaces become U+2581 and one is put before a text, as the model file asks.  No piece holds U+2581 after another
character, so the best path always has a cut before a run of U+2581: a text is encoded unit by unit (such a run and
the word after it), and a worker keeps the pieces of units that it has met.

Defined results: null and empty texts have no ids and decode to the empty text; decoding gives back the text with
every character as it was (line ends and tabs through byte pieces).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

SPACE_MARK = "▁"
#: Units kept by a worker before it starts afresh; bounds its memory, not the result.
KEPT_UNITS = 400_000
KEPT_LENGTH = 64
_UNIT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


class Pieces:
    """The pieces of a model file and their automaton."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        self.bytes = [0] * 256
        self.plain: dict[str, tuple[int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE_MARK in piece.lstrip(SPACE_MARK):
                    raise ValueError(f"piece {piece!r} crosses a space")
                self.plain[piece] = (i, float(scores[i]))
                self.automaton.add_word(piece, (i, len(piece), float(scores[i])))
        self.automaton.make_automaton()
        #: below any path by pieces that covers the same characters
        self.fallback = 2 * min([s for _, s in self.plain.values()], default=-1.0) * max(map(len, self.plain), default=1)
        self.kept: dict[str, bytes] = {}
        byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.spelled = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def unit(self, text: str) -> list[int]:
        """The ids of the best segmentation of one unit; of equal scores, the longer last piece."""
        n = len(text)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here are final: all pieces that end there were seen
        for end, (piece, length, score) in self.automaton.iter(text):
            while done < end:
                done += 1
                self._fall(best, back, done)
            start = end + 1 - length
            s = best[start] + score
            if s > best[end + 1] or s == best[end + 1] and start < back[end + 1][0]:
                best[end + 1], back[end + 1] = s, (start, piece)
        while done < n:
            done += 1
            self._fall(best, back, done)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out.extend([piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[start:at].encode())])
            at = start
        return out[::-1]

    def _fall(self, best, back, at: int) -> None:
        if best[at - 1] + self.fallback > best[at]:
            best[at], back[at] = best[at - 1] + self.fallback, (at - 1, -1)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out = []
        kept = self.kept
        for k, part in enumerate(text.split(SPACE_MARK)):
            if k:  # the mark itself in a text: as bytes, so that it is not read as a space again
                out.append(np.array([self.bytes[b] for b in SPACE_MARK.encode()], np.int32).tobytes())
            part = part.replace(" ", SPACE_MARK)
            for unit in _UNIT.findall(part if k else SPACE_MARK + part):
                ids = kept.get(unit)
                if ids is None:
                    ids = np.array(self.unit(unit), np.int32).tobytes()
                    if len(unit) <= KEPT_LENGTH:
                        if len(kept) >= KEPT_UNITS:
                            kept.clear()
                        kept[unit] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        table = self.spelled
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


_models: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of this worker; the file is at the same path on every machine."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for c in chunks(batches):
            ids = [model.encode(t or "") for t in c.rows.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                c.rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])
    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for x in part.column("ids"):
                    ids = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)
                    out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), model.decode(ids.tolist())))
                n, crc, text = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                                  pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)
    and the text that they spell."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, n_tokens long, ids_crc32 long, text string")
