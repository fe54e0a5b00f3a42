"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, piece encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  ``run`` applies them to ``documents`` in that way.  All but the
last return the columns of ``documents``; a document that the mix takes twice is two rows.
"""

from __future__ import annotations

from sightline.llm.common import table, tokenizer_file
from sightline.llm.exact_dedup import drop_copies
from sightline.llm.minhash import drop_near
from sightline.llm.mixing import mixed_documents
from sightline.llm.quality import keep_good
from sightline.llm.sentencepiece import encode
from sightline.session import cut_lineage

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: keep_good(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: drop_copies(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: drop_near(docs)),
    ("mix_sources", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("encode_pieces", lambda spark, docs, sf_dir: encode(docs, tokenizer_file("piece_bpe_32k.model"))),
]

#: Expectation-maximisation, minimum hashes and the piece search are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
