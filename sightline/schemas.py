"""Fixed values, column names and schemas.

The lists under "fixed values" must equal the reference tool's values for the
results to agree; they are written out plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's)
# ---------------------------------------------------------------------------

# Comment purposes, in label order (code = position).
PURPOSE_LABELS = [
    "acknowledgement",
    "change_request",
    "discussion_participation",
    "discussion_trigger",
    "same_as",
]

# Comment subjects, in column order.
SUBJECT_COLUMNS = [
    "code_design",
    "code_style",
    "code_naming",
    "code_logic",
    "code_io",
    "code_data",
    "code_doc",
    "code_api",
    "compatibility",
    "rule_def",
    "config_commit_patch_review",
    "config_building_installing",
]

# Characters that are tokens of their own in code lines (between brackets of a
# regular-expression class).  Python's Unicode \s also covers \x1c-\x1f, which
# Java's (?U)\s does not, hence the explicit range.
CODE_DELIMITER_CLASS = r"""\s\x1c-\x1f()\[\]{}!@#$%^&*/+\-=;:\\|`'"~,.<>?"""

# Base vocabulary, in id order (the published BERT base dictionary).
TOKEN_PAD = ""
TOKEN_UNK = "[UNK]"
TOKEN_CLS = "[CLS]"
TOKEN_SEP = "[SEP]"
TOKEN_MASK = "[MASK]"
BASE_TOKENS = [TOKEN_PAD, TOKEN_UNK, TOKEN_CLS, TOKEN_SEP, TOKEN_MASK]
TOKEN_NUMBER = "[NUMBER]"

# Identifier signature tokens added by the vocabulary builder, in order.
SIGNATURE_TOKENS = ["Aa0", "Aa_", "Aa", "a0", "0a", "a_", "_a", "0a_", "_a0", "_0a", "_a0a",
                    "0A", "A0", "A_", "_A", "_A0", "_0A", "0_"]

# Single characters added by the vocabulary builder: first all as word pieces
# ("##" + c), then all bare, each in this order.
VOCAB_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"

# Separator of concatenated messages / lines in the review report.
DIGEST_SEPARATOR = " ||| "

# Purposes shown as badges in the review page, in display order.
BADGE_PURPOSES = ["change_request", "discussion_trigger", "discussion_participation"]

# Defaults of the reference jobs.
DEFAULT_SEQ_LEN = 128
DEFAULT_LINE_REPEAT_PERIOD = 64
DEFAULT_PAIRS_PER_SHARD = 10000
DEFAULT_CUT_OFF_PERCENTILE = 50
DEFAULT_CUT_OFF_SAMPLE = 500
DEFAULT_MINKOWSKI_P = 6
DEFAULT_CLASSIFY_THRESHOLD = 0.5

# ---------------------------------------------------------------------------
# Schemas of the reference's tables
# ---------------------------------------------------------------------------

COMMENTED_LINES_SCHEMA = T.StructType([
    T.StructField("change_id", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("revision_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("line_contents", T.StringType()),
    T.StructField("message", T.StringType()),
])

ADDED_LINES_SCHEMA = T.StructType([
    T.StructField("change_id", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("revision_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("line_contents", T.StringType()),
])

_COMMENT = T.StructType([
    T.StructField("line", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("range", T.StructType([
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ])),
])

_HUNK = T.StructType([
    T.StructField("a", T.ArrayType(T.StringType())),
    T.StructField("b", T.ArrayType(T.StringType())),
    T.StructField("ab", T.ArrayType(T.StringType())),
])

# One review document: change -> revisions -> files, each file with its content,
# the review comments on it and its diff hunks.
REVIEW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("revisions", T.MapType(T.StringType(), T.StructType([
        T.StructField("files", T.MapType(T.StringType(), T.StructType([
            T.StructField("content", T.StringType()),
            T.StructField("comments", T.ArrayType(_COMMENT)),
            T.StructField("diff", T.ArrayType(_HUNK)),
        ]))),
    ]))),
])


def labelled_comments_schema(subjects=SUBJECT_COLUMNS) -> T.StructType:
    return T.StructType(
        [T.StructField("line_contents", T.StringType()),
         T.StructField("message", T.StringType()),
         T.StructField("purpose", T.StringType())]
        + [T.StructField(s, T.DoubleType()) for s in subjects])
