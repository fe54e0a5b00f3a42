"""Flagship similarity job (row 100)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similar as sm


def find_similar(reference: DataFrame, queries: DataFrame, cut_off_percentile: float | None = 50,
                 max_similar: int | None = None, cut_off_sample: int | None = None, seed: int = 0,
                 metric=None) -> DataFrame:
    """Row 100: ``query_id, query_line, similar_line, distance, rank`` for every query
    row (duplicates kept).  ``reference``: ``ref_id, line, embedding``; ``queries``:
    ``query_id, query_line, embedding``.  With a cut-off percentile: all references
    within it (at most ``max_similar``); without: the ``max_similar`` nearest, which
    must be given then.  ``cut_off_sample``: the cut-off of so many references only."""
    if cut_off_percentile is None and max_similar is None:
        raise ValueError("without a cut-off, max_similar must say how many references to return")
    cells = sm.reference_cells(reference.select("ref_id", "embedding"), metric)
    qs = queries.select("query_id", "embedding")
    if cut_off_percentile is not None:
        cut = sm.similarity_cutoff(reference, cut_off_percentile, cut_off_sample, seed, cells=cells)  # one scalar
        pairs = sm.radius_join(qs, cells, cut, max_similar)
    else:
        pairs = sm.knn_join(qs, cells, max_similar)
    return (pairs.join(queries.select("query_id", "query_line"), "query_id")
            .join(reference.select("ref_id", F.col("line").alias("similar_line")), "ref_id")
            .select("query_id", "query_line", "similar_line", "distance", "rank"))
