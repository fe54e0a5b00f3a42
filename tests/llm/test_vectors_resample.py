"""Top-k products, integer codebooks and resampling against brute force in plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import hadamard_codes as hc
from sightline.llm import resample as rs
from sightline.llm import threshold_search as ts

VECTORS = "vec_id long, embedding array<double>, label int, q long, node string, score int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "n", 2) for i, v, lab in rows], VECTORS)


def taking_part(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_top(rows, modulo, k, scale=256):
    """Rows (query id, rank, id, score); a query leaves itself out, rows with the same id are rows of their own."""
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in taking_part(rows)]
    out = []
    for a, (i, v) in enumerate(ints):
        if i is None or i % modulo:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), -ts.LAST - 1), ts.LAST), j is None, j or 0, j) for b, (j, w) in enumerate(ints) if a != b]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored)[:k])]
    return out


def some_vectors(seed, n, width=6):
    rng = random.Random(seed)
    spot = [[round(rng.gauss(0, 0.4), 2) for _ in range(width)] for _ in range(n // 3)]
    rows = [(i, list(rng.choice(spot)) if rng.random() < 0.6 else [rng.gauss(0, 0.4) for _ in range(width)], rng.choice([0, 1, None]))
            for i in rng.sample(range(10 * n), n)]
    common = spot[0]
    return [(i, list(common) if j % 3 == 0 else v, lab) for j, (i, v, lab) in enumerate(rows)]  # a third are copies


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_top_products(spark, parts, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_ROWS", 16)  # several blocks of objects and of queries
    monkeypatch.setattr(ts, "QUERY_ROWS", 8)
    rows = some_vectors(parts, 160) + [(3000, None, 1), (3001, [1.0, None] + [0.0] * 4, 1), (3002, [math.nan] * 6, 1), (3003, [math.inf] * 6, 1),
                                       (3005, [0.0] * 6, 1), (3010, [0.0] * 6, 1), (None, [0.9] * 6, 1), (3020, [0.5, -0.25], 0)]
    got = ts.top_k(vector_frame(spark, rows), F.col("id") % 5 == 0, 4, parts=parts)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 5, 4))


def test_top_products_ties_repeats_and_small_tables(spark):
    same = [(i, [0.25, 0.5], 0) for i in range(1, 41)]
    got = ts.top_k(vector_frame(spark, same), F.col("id") % 10 == 0, 3).collect()
    assert sorted(map(tuple, got)) == sorted(brute_top(same, 10, 3))
    zeros = [(i, [0.0, 0.0], 0) for i in range(5, 30)] + [(i, [0.1 * i, 1.0], 0) for i in range(30, 40)]
    assert sorted(map(tuple, ts.top_k(vector_frame(spark, zeros), F.col("id") % 5 == 0, 3).collect())) == sorted(brute_top(zeros, 5, 3))
    twice = [(10, [1.0, 2.0], 0), (10, [1.0, 2.0], 0), (10, [3.0, 1.0], 0), (7, [0.5, 0.5], 0)]
    assert sorted(map(tuple, ts.top_k(vector_frame(spark, twice), F.col("id") % 10 == 0, 5).collect())) == sorted(brute_top(twice, 10, 5))
    assert ts.top_k(vector_frame(spark, [(10, [1.0], 0)]), F.col("id") % 10 == 0).collect() == []
    assert ts.top_k(vector_frame(spark, [(11, [1.0], 0)]), F.col("id") % 10 == 0).collect() == []
    assert ts.top_k(vector_frame(spark, []), F.col("id") % 10 == 0).collect() == []
    wide = [(i, [float(1 << 45) * (1 if i % 2 else -1), float(i)], 0) for i in range(8)]  # sums leave doubles and 64 bits
    assert sorted(map(tuple, ts.top_k(vector_frame(spark, wide), F.col("id") % 2 == 0, 3).collect())) == sorted(brute_top(wide, 2, 3))


def test_threshold_lets_little_through(spark):
    """The second phase's entries, not only the result: far fewer than all (query, object) pairs."""
    rng = np.random.default_rng(4)
    m = np.floor(256 * rng.normal(0, 0.1, (4096, 64))).astype(np.int64)
    whole = ts.products(m, m[:64])
    tau = np.sort(whole, axis=0)[-6]
    halves = [ts.products(m[:, :32], m[:64, :32]), ts.products(m[:, 32:], m[:64, 32:])]
    let = sum(int((2 * h > tau).sum()) for h in halves)
    assert all(((2 * h > tau).any() for h in halves)) and let < 0.05 * whole.size
    assert ((2 * halves[0] > tau) | (2 * halves[1] > tau))[whole > tau].all()


def brute_codes(rows, n_parts, n_entries, rounds, scale):
    kept = taking_part(rows)
    width = max((len(v) for _, v, _ in kept), default=1)
    w = -(-width // n_parts)
    ints = [(i, [math.floor(scale * x) for x in v] + [0] * (w * n_parts - len(v)), lab) for i, v, lab in kept]
    first = [v for _, v, _ in sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:n_entries]]
    books = [[v[p * w:(p + 1) * w] for v in first] for p in range(n_parts)]

    def best(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        told = [[best(p, v)[1] for p in range(n_parts)] for _, v, _ in ints]
        for p in range(n_parts):
            for e in range(len(first)):
                own = [v[p * w:(p + 1) * w] for (_, v, _), t in zip(ints, told) if t[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    rest = [(i, lab, [best(p, v) for p in range(n_parts)]) for i, v, lab in ints]
    by_label = {}
    for _, lab, b in rest:
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in b)
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return [(i, "".join("%02x" % e for _, e in b), sum(d for d, _ in b), by_label[lab], sha) for i, lab, b in rest], books


@pytest.mark.parametrize("width, n_parts", [(16, 4), (10, 4), (6, 2)])
def test_codes(spark, width, n_parts):
    rows = some_vectors(width, 150, width) + [(5000, None, 1), (5001, [None] * width, 1), (5002, [math.nan] * width, 1),
                                              (5003, [0.5] * (width - 3), 0), (None, [0.1] * width, None)]
    want, books = brute_codes(rows, n_parts, 5, 3, 4096)
    got = hc.compress(vector_frame(spark, rows), n_parts=n_parts, n_entries=5, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    made = hc.codebooks(vector_frame(spark, rows), n_parts, 5, 3)
    assert made.tolist() == books
    back = hc.decode(hc.encode(vector_frame(spark, rows), made), made).collect()
    ints = {i: [math.floor(4096 * x) for x in v] for i, v, _ in taking_part(rows)}
    for r in back:  # what decoding gives lies at the distance that was told
        v = ints[r.vec_id] + [0] * (len(r.approx) - len(ints[r.vec_id]))
        assert sum((a - b) ** 2 for a, b in zip(v, r.approx)) == r.error


def test_codes_of_few_repeated_and_no_rows(spark):
    for rows in ([(4, [1.0, 2.0], 0)], [(4, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (4, [0.0, 1.0], 1)]):
        got = hc.compress(vector_frame(spark, rows), n_parts=2, n_entries=4, rounds=2)
        assert sorted(map(tuple, got.collect())) == sorted(brute_codes(rows, 2, 4, 2, 4096)[0])
    assert hc.compress(vector_frame(spark, [])).collect() == []


def test_nearest_is_exact_at_every_size():
    rng = np.random.default_rng(8)
    for high in (3, 1 << 12, 1 << 40, 1 << 61):
        for width in (1, 3, 8):
            x = rng.integers(-high, high, (60, width))
            e = np.concatenate([x[:4], rng.integers(-high, high, (5, width)), x[:2]])  # copies of entries: ties
            code, d = hc.nearest(x, e)
            want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)), k) for k, c in enumerate(e)) for r in x]
            assert list(zip(map(int, d), map(int, code))) == want


def test_sequency_order():
    for size in (1, 2, 8, 16):
        m = hc.transform(np.eye(size, dtype=np.int64), hc.sequency_order(size)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in m] == list(range(size))
        assert (m @ m.T == size * np.eye(size)).all()


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_resample(docs, target, n, buckets, min_words, percent):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    own, goal = [features(t) for _, t in docs], [f for _, t in target for f in features(t)]
    s, t = [0] * buckets, [0] * buckets
    for f in own:
        for b in f:
            s[b] += 1
    for b in goal:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for (d, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("n, head", [(1, 1 << 15), (1, 5), (2, 40), (3, 0)])
def test_resample(spark, n, head):
    rng = random.Random(n)
    v = ["".join(rng.choice("abcdeéß漢7") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: rng.choice([" ", "\n", "--", "_"]).join(rng.choice(v[:20] if rng.random() < 0.5 else v) for _ in range(k))
    docs = [(i, text(rng.choice([1, 5, 20, 60]))) for i in rng.sample(range(1000), 120)]
    docs += [(2000, None), (2001, ""), (2002, "  .,! "), (2003, "Word " * 40), (2003, "Word " * 40), (None, text(30)), (2004, "x" * 50_000), (2005, text(30_000))]
    docs += [(3000 + i, "same words again and again " * 5) for i in range(60)]
    goal = [(i, text(30)) for i in range(10)] + [(11, None)]
    schema = "doc_id long, text string, n_words string, found long, rank int"
    frame = spark.createDataFrame([(d, t, "x", 1, 1) for d, t in docs], schema).repartition(5)
    target = spark.createDataFrame(goal, "item_id long, text string")
    got = rs.resample(frame, target, n, 97, min_words=20, percent=30, head=head)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_resample(docs, goal, n, 97, 20, 30), key=key)


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert rs.resample(none, some).collect() == []
    assert [tuple(r) for r in rs.resample(some, none, percent=100).collect()] == brute_resample([(1, "a b " * 20)], [], 1, rs.BUCKETS, 20, 100)


def test_head_is_the_frequent_words(spark):
    docs = spark.createDataFrame([(i, "the cat " * 5 + f"w{i}") for i in range(50)], "doc_id long, text string").repartition(7)
    assert rs.head_runs(docs, size=2) == [b"cat", b"the"]
    assert rs.head_runs(docs, pairs=True, size=2) == [b"the cat", b"cat the"]
