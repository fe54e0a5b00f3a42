"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text.  Votes are counted by pattern (at most 2 ** rules
patterns, as a rule votes one way, whatever the input's size), expectation-maximisation on those counts estimates how
often good and bad texts get each vote, and every text gets the posterior probability of being good.  Good-voting rules
look at other things than the bad-voting ones, so both may vote on a text and a single bad vote can be overturned.

Defined results: null text is a text without words; it and texts under ``MIN_WORDS`` words fail the base rules and
are never kept.  Repeated rows are judged each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .common import Chunk, chunks, mix, repeats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_distinct", "n_marks", "n_stops", "n_function"]
#: Frequent words that carry grammar, in some languages of Latin and Cyrillic script.
FUNCTION_WORDS = """the of and to in is was that for it with as on be at by this from or are der die das und ist nicht ein eine zu
    den von mit auf für im dem sich des es auch le la les et un une est que qui dans pour pas sur par au avec ce el los las y
    en por con del se al su lo como para o e il di che non per da não um os do em het een van и в не на что с по как это""".split()
#: rule -> (numerator, denominator, vote, from, to): the rule votes where from <= numerator / denominator < to
RULES = {
    "symbols": ("n_symbols", "n_words", -1, 0.2, None),
    "repeated_words": ("n_repeat_words", "n_words", -1, 0.4, None),
    "repeated_lines": ("n_dup_lines", "n_lines", -1, 0.5, None),
    "shouting": ("n_upper", "n_letters", -1, 0.5, None),
    "exclamations": ("n_marks", "n_words", -1, 0.3, None),
    "long_words": ("word_chars", "n_words", -1, 14.0, None),
    "sentences": ("n_stops", "n_words", 1, 0.03, 0.25),
    "word_length": ("word_chars", "n_words", 1, 3.5, 6.5),
    "varied_words": ("n_distinct", "n_words", 1, 0.4, None),
    "line_length": ("n_words", "n_lines", 1, 4.0, 100.0),
    "function_words": ("n_function", "n_words", 1, 0.1, 0.7),
}
#: What is expected before looking at the data: the share of bad and of good texts that get a vote, and of bad texts
#: among all.  It weighs as much as PRIOR texts of each kind, so any larger input overrules it.
RATES = {-1: (0.2, 0.01), 1: (0.5, 0.9)}
BAD_SHARE = 0.1
PRIOR = 10.0


@functools.cache
def _function_hashes() -> np.ndarray:
    words = " ".join([*FUNCTION_WORDS, *(w.capitalize() for w in FUNCTION_WORDS)]).encode()
    c = Chunk(None, np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    starts, ends, _ = c.words()
    return np.unique(c.span_hashes(starts, ends))


@functools.cache
def _scripts() -> tuple[np.ndarray, np.ndarray]:
    """Whether code points under 0x20000 are letters, and capitals; all ideographs above are letters."""
    chars = [chr(i) for i in range(0x20000)]
    return np.array([x.isalpha() for x in chars]), np.array([x.isupper() for x in chars])


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of letters of all scripts, and of capitals."""
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122))
    if len(data) and data.max() >= 0xC2:
        is_letter, is_upper = _scripts()
        for low, high, more in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3)):
            at = np.flatnonzero((data >= low) & (data < high))
            at = at[at + more < len(data)]
            code = data[at].astype(np.int64) & (0x3F >> more)
            for i in range(1, more + 1):
                code = code << 6 | (data[at + i] & 0x3F)
            known = np.minimum(code, 0x1FFFF)
            letter[at] = is_letter[known] | (code >= 0x20000) & (code < 0x40000)
            upper[at] = is_upper[known]
    return letter, upper


def _counts(c: Chunk) -> list[np.ndarray]:
    data, n = c.data, c.n
    row = np.repeat(np.arange(n), np.diff(c.offs))
    starts, ends, doc = c.words()
    n_words = c.per_row(doc)
    space_free = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=space_free[1:])
    word_chars = c.per_row(doc, space_free[ends] - space_free[starts])
    h = c.span_hashes(starts, ends)
    later, _ = repeats(doc, h)
    # lines: \n-split spans with a word in them
    ls, le, ldoc = c.spans(data != 10)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, ldoc = ls[has_word], le[has_word], ldoc[has_word]
    dup, _ = repeats(ldoc, c.span_hashes(ls, le))
    # three-word windows that stay in a row
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        one = np.flatnonzero(doc[2:] == doc[:-2])
        h3 = mix(h[one] + mix(h[one + 1] + mix(h[one + 2])))
        _, many = repeats(doc[one], h3)
        np.add.at(covered, one[many], 1)
        np.add.at(covered, one[many] + 3, -1)
    in_window = np.cumsum(covered[:-1]) > 0
    letter, upper = _letters(data)
    known = _function_hashes()
    function = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    two = np.zeros(len(data), bool)
    two[1:] = (data[1:] == 33) & (data[:-1] == 33)
    last = data[ends - 1] if len(ends) else data
    return [n_words, word_chars, c.per_row(row, SYMBOLS[data]), c.per_row(ldoc, dup), c.per_row(doc, in_window),
            c.per_row(ldoc), c.per_row(row, upper), c.per_row(row, letter), c.per_row(doc, ~later), c.per_row(row, two),
            c.per_row(doc, last == 46), c.per_row(doc, function)]


def _measure(carried: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            yield pa.RecordBatch.from_arrays([c.rows.column(carried), *map(pa.array, _counts(c))], [carried, *COUNTS])
    return run


def measure(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """``COUNTS`` of every whole ``text``, beside one more column of ``docs``."""
    schema = StructType([docs.schema[carried], *(StructField(c, LongType()) for c in COUNTS)])
    return docs.select(carried, "text").mapInArrow(_measure(carried), schema)


def votes(counts: DataFrame, rules: dict = RULES) -> DataFrame:
    """Adds one column ``vote_<rule>`` (1 good, -1 bad, 0 abstains) per rule; a zero denominator abstains."""
    out = {}
    for name, (num, den, vote, low, high) in rules.items():
        share = F.col(num) / F.nullif(F.col(den), F.lit(0))
        hit = share >= low if high is None else (share >= low) & (share < high)
        out["vote_" + name] = F.when(hit, vote).otherwise(0).cast("int")
    return counts.withColumns(out)


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) seen ``n`` times: P(good) per pattern, and per rule the estimated
    accuracy of its bad and of its good votes.

    A vote moves the odds by how much more often bad texts get it than good ones, never against its own direction.
    That a good-voting rule abstains speaks against a text only beside a bad vote: alone it would reject whatever the
    rules do not know, such as other languages."""
    n = np.asarray(n, float)
    cast = {v: patterns == v for v in (-1, 0, 1)}  # pattern, rule
    votes_good, alarmed = cast[1].any(0), cast[-1].any(1)
    rates = {v: [np.full(patterns.shape[1], x) for x in RATES[v]] for v in RATES}  # among bad, among good texts
    share, bad = BAD_SHARE, np.zeros(len(n))
    for _ in range(rounds):
        against = np.where(votes_good, np.maximum(np.log1p(-rates[1][0]) - np.log1p(-rates[1][1]), 0), 0)
        odds = np.log(share) - np.log1p(-share) + cast[-1] @ np.maximum(np.log(rates[-1][0] / rates[-1][1]), against) \
            + cast[1] @ np.minimum(np.log(rates[1][0] / rates[1][1]), 0) + np.where(alarmed, cast[0] @ against, 0)
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done, bad = np.abs(new - bad).max(initial=0) < 1e-9, new
        if done:
            break
        for v in rates:
            rates[v] = [((n * t) @ cast[v] + PRIOR * x) / ((n * t).sum() + PRIOR) for t, x in zip((bad, 1 - bad), RATES[v])]
        share = float(np.clip((n @ bad + PRIOR * BAD_SHARE) / (n.sum() + PRIOR), 1e-6, 0.5))
    right = [(share * rates[-1][0]) / (share * rates[-1][0] + (1 - share) * rates[-1][1]),
             ((1 - share) * rates[1][1]) / (share * rates[1][0] + (1 - share) * rates[1][1])]
    return 1 - bad, np.stack(right)


def verdicts(voted: DataFrame, rules: dict = RULES) -> DataFrame:
    """The posterior probability of good (``quality``) of every vote pattern in ``voted``: at most one row per pattern."""
    names = ["vote_" + r for r in rules]
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** len(rules) rows
    patterns = np.array([[x[c] for c in names] for x in rows], int).reshape(len(rows), len(names))
    good, _ = estimate(patterns, np.array([x["n"] for x in rows], float))
    return voted.sparkSession.createDataFrame([(*map(int, p), float(g)) for p, g in zip(patterns, good)],
                                              ", ".join(f"{c} int" for c in names) + ", quality double")


def judged(voted: DataFrame, told: DataFrame, rules: dict = RULES, keep: float = KEEP) -> DataFrame:
    """``voted`` with quality, base_failed and kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.join(F.broadcast(told), ["vote_" + r for r in rules]).withColumn("base_failed", base_failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept and quality."""
    voted = cut_lineage(votes(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))))
    return judged(voted, verdicts(voted)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                 "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns.  Texts are read and measured twice (once for the votes
    of all rows, once to let the kept rows through) and never shuffled or stored."""
    voted = votes(measure(docs.select("doc_id", "text")))
    told = verdicts(voted)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return judged(votes(measure(rows, "doc")), told).where("kept").select("doc.*")
