"""Vector expressions (rows 79, 85-87): Catalyst higher-order functions, and the poolings of many tokens in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def minkowski(x, y, p: float = 6) -> Column:
    """Row 85: Minkowski distance in double; p in {1, 2, 6, ...} or ``math.inf``."""
    diffs = F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    if math.isinf(p):
        return F.aggregate(diffs, F.lit(0.0), lambda acc, d: F.greatest(acc, d))
    if p == 1:
        return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)
    s = F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + F.pow(d, F.lit(float(p))))
    return F.pow(s, F.lit(1.0 / p))


METRICS = {"minkowski": 6, "euclidean": 2, "l2": 2, "manhattan": 1, "cityblock": 1, "l1": 1,
           "chebyshev": math.inf, "infinity": math.inf}


def metric_p(metric: str | float | None) -> float:
    """Row 107: a metric name (or a p) -> Minkowski p; None -> the default p = 6."""
    if metric is None:
        return 6
    if isinstance(metric, (int, float)):
        return float(metric)
    return METRICS[metric]


def pool_first(vectors) -> Column:
    """Row 86 POOL_NSP: the first token's vector."""
    return F.try_element_at(_c(vectors), F.lit(1))


def pool_mean(vectors) -> Column:
    """Row 86 POOL_AVE: mean over positions (element-wise)."""
    v = _c(vectors)
    n = F.size(v).cast("double")
    width = F.size(F.try_element_at(v, F.lit(1)))
    sums = F.aggregate(v, F.array_repeat(F.lit(0.0), width),
                       lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b.cast("double")))
    return F.transform(sums, lambda s: s / n)


def pool_max(vectors, mask=None) -> Column:
    """Row 86 POOL_MAX: element-wise maximum over the positions whose mask is true."""
    v = _c(vectors)
    if mask is not None:
        v = F.filter(F.arrays_zip(v.alias("v"), _c(mask).alias("m")), lambda z: z["m"])
        v = F.transform(v, lambda z: z["v"])
    width = F.size(F.try_element_at(v, F.lit(1)))
    return F.aggregate(v, F.array_repeat(F.lit(float("-inf")), width),
                       lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b.cast("double"))))


#: Tokens that a pooling of tokens takes at once.
PIECE = 1 << 15


def _first_of(v: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, some = np.zeros((len(sizes), v.shape[1])), sizes > 0
    out[some] = v[of[(np.cumsum(sizes) - sizes)[some]]]
    return out


def _mean_of(v: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(sizes), v.shape[1])), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(of), PIECE):
        row, own = rows[at:at + PIECE], v[of[at:at + PIECE]]
        first, last = row[0], row[-1] + 1
        row = np.append(first, row) - first  # the first row's sum so far goes before its other tokens: added in their order
        for j in range(v.shape[1]):
            out[first:last, j] = np.bincount(row, np.append(out[first, j], own[:, j]), last - first)
    return out / np.maximum(sizes, 1)[:, None]


def _max_of(v: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, some = np.zeros((len(sizes), v.shape[1])), sizes > 0
    if some.any():
        out[some] = np.maximum.reduceat(v[of], (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


#: The poolings of row 86 over different vectors ``v``, each position's vector ``of`` and the positions per row ``sizes``;
#: zeros for a row without positions.
POOLS = {"first": _first_of, "mean": _mean_of, "max": _max_of}


def concat_pools(*pooled) -> Column:
    """Several poolings concatenated, in the given order."""
    return F.concat(*pooled)


def concat_layers(layers, n_layers: int) -> Column:
    """Row 87 (Q18 kept): concatenate the vectors of layers 1..n, ascending.
    ``layers`` is an array (one entry per layer) of arrays."""
    l = _c(layers)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n_layers)), lambda i: F.element_at(l, i)))


def trim_padding(token_ids, vectors=None) -> Column:
    """Row 79: length up to the last non-zero id; with ``vectors``, cut them there."""
    ids = _c(token_ids)
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), F.lit(0),
                       lambda acc, i: F.when(F.coalesce(F.element_at(ids, i), F.lit(0)) != 0, i).otherwise(acc))
    if vectors is None:
        return last
    return F.slice(_c(vectors), 1, last)
