"""Code-line text functions.

All of them are Catalyst expressions (regular expressions, higher-order array
functions), so they run inside whole-stage code generation; no Python UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CODE_DELIMITER_CLASS, SIGNATURE_TOKENS, TOKEN_NUMBER

# A single delimiter character, or a run of non-delimiters.  (?U) makes \s the
# Unicode white-space class, like Python's re on str.
SPLIT_CODE_PATTERN = "(?U)[" + CODE_DELIMITER_CLASS + "]|[^" + CODE_DELIMITER_CLASS + "]+"
DIGITS_PATTERN = r"^\p{Nd}+$"
# Internal piece separator: a Unicode non-character, never produced by text.
_CUT = "﷐"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_code(line) -> Column:
    """Row 68: each delimiter character is a token, runs between are tokens.
    Empty tokens never occur.  Null line -> null array."""
    return F.regexp_extract_all(_c(line), F.lit(SPLIT_CODE_PATTERN), 0)


def drop_blank_tokens(tokens) -> Column:
    """Row 69: remove tokens that are exactly one space or one tab."""
    return F.filter(_c(tokens), lambda t: ~t.isin(" ", "\t"))


def _prefix_continuations(pieces: Column) -> Column:
    return F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("##"), x)))


def camel_pieces(token) -> Column:
    """Pieces of a camel-case identifier (ASCII letters only)."""
    t = _c(token)
    marked = F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1" + _CUT + "$2"),
                              "([A-Z])([A-Z][a-z])", "$1" + _CUT + "$2")
    return F.split(marked, _CUT, -1)


def camel_split(token) -> Column:
    """Row 70: split at lower->Upper and at Upper->Upper+lower."""
    return camel_pieces(token)


def underscore_pieces(token) -> Column:
    return F.split(F.regexp_replace(_c(token), "_", _CUT + "_" + _CUT), _CUT, -1)


def underscore_split(token) -> Column:
    """Row 71: pieces around '_' (each '_' is a piece too); all but the first get '##'."""
    return _prefix_continuations(underscore_pieces(token))


def is_number(token) -> Column:
    """Row 73 predicate: all characters are decimal digits (\\p{Nd})."""
    return _c(token).rlike(DIGITS_PATTERN)


def number_token(token) -> Column:
    """Row 73: an all-digit token becomes [NUMBER]."""
    t = _c(token)
    return F.when(is_number(t), F.lit(TOKEN_NUMBER)).otherwise(t)


# A camel-case split point exists (lower->Upper, or Upper->Upper+lower).
CAMEL_PATTERN = "[a-z][A-Z]|[A-Z][A-Z][a-z]"


def vocab_word_tokens(token, digit_token: bool = True) -> Column:
    """Vocabulary tokens of one word (row 72, per token).  Each branch is guarded by
    a cheap test, so the splitting work only runs on the tokens that need it."""
    t = _c(token)
    if digit_token:
        digits = F.array(F.lit(TOKEN_NUMBER))
    else:
        digits = _prefix_continuations(F.split(t, "", -1))
    return (F.when(t.contains("_"), underscore_split(t))
            .when(t.rlike(CAMEL_PATTERN), _prefix_continuations(camel_pieces(t)))
            .when(is_number(t), digits)
            .otherwise(F.array(t)))


# A line can only hold a token that needs more than the plain split if it has an
# underscore, a camel-case split point or a decimal digit somewhere.
NEEDS_WORD_RULES = "_|" + CAMEL_PATTERN + r"|\p{Nd}"


def vocab_tokens(line, digit_token: bool = True) -> Column:
    """Row 72: split the line (68), then underscore pieces, else camel-case pieces,
    else digits, else the token itself.  Lines without any underscore, camel-case
    point or digit take the plain split (exact: every token is a substring)."""
    ln = _c(line)
    rules = F.flatten(F.transform(split_code(ln), lambda t: vocab_word_tokens(t, digit_token)))
    return F.when(ln.rlike(NEEDS_WORD_RULES), rules).otherwise(split_code(ln))


# --- identifier signatures (row 74) ---------------------------------------

# SIGNATURE_TOKENS: repeated groups collapsed after the run collapse, in that order.  The
# reference guards each rewrite by the presence of the characters the group
# contains; a group can only match when those are present, so the guards are
# implied by the patterns themselves.
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_DIGITS = "0123456789"


def token_signature(token) -> Column:
    """Row 74: a->lower, A->upper, 0->digit; collapse runs of one character,
    then collapse repeats of each group in SIGNATURE_TOKENS."""
    t = F.translate(_c(token), _LOWER + _UPPER + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    t = F.regexp_replace(t, r"(.)\1+", "$1")
    for g in SIGNATURE_TOKENS:
        t = F.regexp_replace(t, "(?:" + g + "){2,}", g)
    return t


_SAME = str.maketrans(_LOWER + _UPPER + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
_RUN = re.compile("([^\n\r\u0085\u2028\u2029])\\1+")  # what "." is in Spark's expressions
_REPEATS = [(re.compile(f"(?:{g}){{2,}}"), g) for g in SIGNATURE_TOKENS]


def signature_of(token: str) -> str:
    """Row 74 for one token in a Python worker: what ``token_signature`` gives."""
    t = _RUN.sub(r"\1", token.translate(_SAME))
    for repeats, g in _REPEATS:
        t = repeats.sub(g, t)
    return t


# --- output hygiene (row 83) and dates (row 84) -----------------------------

def sanitize_text(text, sep: str = ";") -> Column:
    """Row 83 (Q6 fixed): every CR, LF and separator becomes one space."""
    return F.regexp_replace(_c(text), "[\\r\\n]|" + re.escape(sep), " ")


DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
]


def parse_dates(text, formats=DATE_FORMATS) -> Column:
    """Row 84: text -> timestamp, first format that parses; bad text -> null."""
    t = _c(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])
