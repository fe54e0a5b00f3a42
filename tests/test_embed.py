"""Rows 86, 99: the hashed embedder against a plain loop, in slices of any size."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as e
from sightline.operators import embed as em
from sightline.functions import vectors as ve
from sightline.functions.text import split_code
from pyspark.sql import functions as F

LINES = ["", " \t", "a", "int fooBar = 42;", "a b a b a", "x_y " * 40, "é ß \U0001f600 ²", "a", None]


def _vector(token: str, dim: int) -> list[float]:
    h = "".join(hashlib.sha256(("#" * m + token).encode()).hexdigest() for m in range((dim + 15) // 16))
    return [int(h[4 * j:4 * j + 4], 16) / 65535.0 - 0.5 for j in range(dim)]


def _mean(vs: list[list[float]], dim: int) -> list[float]:
    out = [0.0] * dim
    for v in vs:
        out = [a + b for a, b in zip(out, v)]
    return [a / len(vs) for a in out] if vs else out


@pytest.mark.parametrize("slice_tokens, piece", [(1 << 16, 1 << 15), (5, 3), (1, 1)])
def test_embedder_equals_a_loop(spark, monkeypatch, slice_tokens, piece):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "i int, line string")
    told = df.select("i", F.filter(split_code(F.coalesce("line", F.lit(""))), lambda t: ~t.isin(" ", "\t")).alias("t"))
    tokens = {r["i"]: r["t"] for r in told.collect()}
    cut = lambda c: F.filter(split_code(c), lambda t: ~t.isin(" ", "\t"))
    # the task's own function, run here so that the sizes reach it
    held = {}
    monkeypatch.setattr(em, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(ve, "PIECE", piece)
    import pyarrow as pa
    words = pa.array([["before"]] + [tokens[i] for i in range(len(LINES))]).slice(1)
    for at, n, own, of, sizes in em._slices(words):
        assert n == 1 or len(of) <= slice_tokens
        v = em.token_vectors(own, 20)
        for k in range(n):
            held[at + k] = {p: ve.POOLS[p](v, of, sizes)[k].tolist() for p in ve.POOLS}
    for i in range(len(LINES)):
        vs = [_vector(t, 20) for t in tokens[i]]
        assert held[i]["first"] == (vs[0] if vs else [0.0] * 20)
        assert held[i]["mean"] == _mean(vs, 20)
        assert held[i]["max"] == ([max(x) for x in zip(*vs)] if vs else [0.0] * 20)
    got = em.embed_lines(df, "line", 40, tokenizer=cut, distinct=False, keep=["i"]).collect()
    for r in got:
        vs = [_vector(t, 20) for t in tokens[r["i"]]]
        want = np.array([*(vs[0] if vs else [0.0] * 20), *_mean(vs, 20)]).astype(np.float32)
        assert np.array_equal(np.array(r["embedding"], np.float32), want)
    seen = em.line_token_vectors(df, F.coalesce("line", F.lit("")), 20, "v", cut).collect()
    assert all(r["v"] == [_vector(t, 20) for t in tokens[r["i"]]] for r in seen) and len(seen) == len(got) == len(LINES)


@pytest.mark.parametrize("name", ["embed_lines", "pool_vectors"])
def test_tokens_are_hashed_in_slices_not_one_by_one(spark, name):
    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "MapInArrow" in plan
