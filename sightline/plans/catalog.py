"""Registry of named queries (one per SURVEY section 2 row) and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (or
views Spark derives from them).  The oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    # importing registers
    from . import text_queries, dataset_queries, similar_queries, recommend_queries, eval_queries, corpus_queries, pair_queries, io_queries, stream_queries  # noqa: F401
    return QUERIES, ORACLE
