"""DuckDB SQL text of the same rules, for the independent oracle only.

DuckDB uses RE2: no look-around, no back references, ASCII \\s.  The white-space
characters Python's re treats as \\s are therefore listed explicitly.
"""

from __future__ import annotations

from ..schemas import CODE_DELIMITER_CLASS, SIGNATURE_TOKENS

# Python's Unicode \s (fixed list): TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, EN QUAD .. HAIR SPACE, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE.
_WS_RE2 = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASS_RE2 = CODE_DELIMITER_CLASS.replace(r"\s\x1c-\x1f", _WS_RE2)
CUT = "﷐"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


SPLIT_PATTERN = "[" + _CLASS_RE2 + "]|[^" + _CLASS_RE2 + "]+"


def split_code(e: str) -> str:
    return f"regexp_extract_all({e}, {q(SPLIT_PATTERN)})"


def drop_blank(e: str) -> str:
    return f"list_filter({e}, lambda t: t NOT IN (' ', chr(9)))"


def prefix_cont(e: str) -> str:
    return f"list_transform({e}, lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END)"


def camel_pieces(t: str) -> str:
    inner = f"regexp_replace({t}, '([a-z])([A-Z])', {q(chr(92) + '1' + CUT + chr(92) + '2')}, 'g')"
    outer = f"regexp_replace({inner}, '([A-Z])([A-Z][a-z])', {q(chr(92) + '1' + CUT + chr(92) + '2')}, 'g')"
    return f"string_split({outer}, {q(CUT)})"


def underscore_pieces(t: str) -> str:
    return f"string_split(replace({t}, '_', {q(CUT + '_' + CUT)}), {q(CUT)})"


def is_number(t: str) -> str:
    return f"regexp_full_match({t}, '\\p{{Nd}}+')"


def vocab_word_tokens(t: str) -> str:
    return (f"CASE WHEN contains({t}, '_') THEN {prefix_cont(underscore_pieces(t))} "
            f"WHEN len({camel_pieces(t)}) > 1 THEN {prefix_cont(camel_pieces(t))} "
            f"WHEN {is_number(t)} THEN ['[NUMBER]'] ELSE [{t}] END")


def vocab_tokens(e: str) -> str:
    return f"flatten(list_transform({split_code(e)}, lambda w: {vocab_word_tokens('w')}))"


def number_token(t: str) -> str:
    return f"CASE WHEN {is_number(t)} THEN '[NUMBER]' ELSE {t} END"


def token_signature(e: str) -> str:
    lower = "abcdefghijklmnopqrstuvwxyz"
    t = f"translate({e}, {q(lower + lower.upper() + '0123456789')}, {q('a' * 26 + 'A' * 26 + '0' * 10)})"
    # collapse runs of one character (no back references in RE2)
    t = (f"array_to_string(list_filter(string_split({t}, ''), "
         f"lambda c, i: i = 1 OR c <> string_split({t}, '')[i - 1]), '')")
    for g in SIGNATURE_TOKENS:
        t = f"regexp_replace({t}, {q('(?:' + g + '){2,}')}, {q(g)}, 'g')"
    return t


def md5_bucket(e: str, buckets: int = 100) -> str:
    return f"(('0x' || substr(md5(CAST({e} AS VARCHAR)), 1, 8))::BIGINT % {buckets})"


def md5_int(e: str) -> str:
    return f"('0x' || substr(md5({e}), 1, 8))::BIGINT"
