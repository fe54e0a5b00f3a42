"""Exact, near and substring dedup against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from sightline.llm import exact_dedup, minhash, suffix_dedup  # noqa: E402
from sightline.llm.components import connected_components  # noqa: E402

SCHEMA = "doc_id long, text string, source string, row_no long, keep_id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, "x", 0) for d, t in rows], SCHEMA)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def near_corpus(seed, hub=40):
    rng = random.Random(seed)
    v = vocabulary(rng)
    docs = []
    for _ in range(12):
        base = [rng.choice(v) for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(v)
            docs.append(" ".join(w).replace(" ", rng.choice([" ", "\n", "  "])))
    chain = [rng.choice(v) for _ in range(200)]
    for i in range(hub):  # neighbours are alike, ends are not
        chain = list(chain)
        chain[(i * 7) % 200] = f"new{i}"
        docs.append(" ".join(chain).upper() if i % 3 == 0 else " ".join(chain))
    docs += [None, "", " \n", "one", "One", "two words", "Two  words", "a b c d", "A B c d"]
    ids = rng.sample(range(1000), len(docs))
    return list(zip(ids, docs))


def test_exact(spark):
    rows = [(1, "a"), (3, "a"), (2, "a"), (7, None), (5, ""), (4, "b"), (4, "b"), (9, "A"), (None, "b"), (6, "x" * 100_000)]
    got = exact_dedup.dedup_batch(frame(spark, rows), exact_dedup.DigestIndex(spark)).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted([
        (1, 3, 3, False, sha("a")), (2, 3, 3, False, sha("a")), (3, 3, 3, True, sha("a")), (7, 7, 2, True, sha("")),
        (5, 7, 2, False, sha("")), (4, 4, 3, True, sha("b")), (4, 4, 3, False, sha("b")), (-1, 4, 3, False, sha("b")),
        (9, 9, 1, True, sha("A")), (6, 6, 1, True, sha("x" * 100_000))])
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "row_no", "keep_id", "n"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "a"), (4, "b"), (6, "x" * 100_000), (7, None), (9, "A")]


def test_exact_index_across_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.dedup_batch(frame(spark, [(1, "a"), (2, "b")]), index).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(frame(spark, [(5, "a"), (6, "c"), (7, "c")]), index).collect()}
    assert got == {5: (1, False), 6: (7, False), 7: (7, True)}
    assert index.read().count() == 3
    assert exact_dedup.dedup_batch(frame(spark, []), index).count() == 0
    assert [r.doc_id for r in exact_dedup.drop_copies(frame(spark, [(8, "b"), (9, "d")]), index).collect()] == [9]


def test_exact_index_is_reopened(spark, tmp_path):
    path = str(tmp_path / "it's an index")
    exact_dedup.dedup_batch(frame(spark, [(1, "a"), (2, "b")]), exact_dedup.DigestIndex(spark, path, 5)).collect()
    for forget in (False, True):  # True: a session whose catalog does not know the table
        if forget:
            spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")
        index = exact_dedup.DigestIndex(spark, path)
        assert index.buckets == 5 and index.read().count() == (3 if forget else 2)
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(frame(spark, [(7, "a"), (8, "c")]), index).collect()}
        assert got == {7: (1, False), 8: (8, not forget)}
    assert exact_dedup.DigestIndex(spark, path).read().count() == 3
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 6)
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.parquet").write_bytes(b"")
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, str(other))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    same = {}
    for x, c in got.items():
        assert same.setdefault(c, root[x]) == root[x]
    assert len(set(same.values())) == len(same)
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_near(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_corpus(seed)
    want = brute.components(docs)
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        text = dict(docs)[r.doc_id]
        assert r.n_shingles == len(brute.shingles(text, 4))
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    want5 = brute.components(docs, 5)
    kept = minhash.drop_near(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want5.items() if d == c)


def test_near_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(4, t), (4, t), (2, t + " x"), (None, t), (8, None), (8, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert len(got) == 6 and sum(k for _, _, k in got) == 3  # the document without an id stands first, both empty rows stay
    assert minhash.drop_near(frame(spark, rows)).count() == 3
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_bit_estimate():
    import numpy as np
    rng = np.random.default_rng(0)
    k = minhash.BANDS * minhash.ROWS
    for j in (0.0, 0.5, 0.8, 1.0):
        a = rng.integers(0, 16, (300, k), dtype=np.uint64)
        b = np.where(rng.random((300, k)) < j, a, rng.integers(0, 16, (300, k), dtype=np.uint64))
        assert abs(minhash.estimate(minhash._pack(a), minhash._pack(b)).mean() - j) < 0.02


def passages(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(rng.randint(length - 3, 4 * length)) for _ in range(4)]
    docs = []
    for _ in range(40):
        parts = [text(rng.randint(0, 2 * length)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        docs.append("".join(parts))
    docs += [None, "", "a" * (3 * length), "ab" * length, "xyz" * 200, docs[0], docs[1] + docs[1], shared[0][:length], shared[0][1:length]]
    # many contexts around one gram
    docs += [text(40) + "THE SAME THIRTY OR MORE LETTERS HERE" + text(40) for _ in range(15)]
    rng.shuffle(docs)
    return list(zip(rng.sample(range(500), len(docs)), docs))


@pytest.mark.parametrize("seed,length,gram,block", [(1, 100, 30, 1 << 20), (2, 40, 12, 1 << 9), (3, 100, 30, 1 << 11)])
def test_substrings(spark, monkeypatch, seed, length, gram, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    docs = passages(seed, length)
    want = brute.repeats(docs, length)
    got = suffix_dedup.remove_repeats(frame(spark, docs), length, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("shared,bound", [(30, 4000), (95, 4000), (95, 300)])
def test_substrings_hot_buckets_are_cut_again(spark, monkeypatch, shared, bound):
    """A line in most documents, each with other neighbours: no bucket keeps more than the bound, no repeat is lost."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bound)
    rng = random.Random(shared)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line, passage = say(shared), say(140)
    docs = [(i, say(rng.randint(0, 150)) + line + say(rng.randint(0, 150)) + (passage if i % 9 == 0 else "")) for i in range(120)]
    docs += [(500 + i, "z" * (110 + i) + line + docs[i][1][-60:]) for i in range(20)] + [(600, docs[3][1]), (601, docs[3][1] + line + "y")]
    got = suffix_dedup.remove_repeats(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(docs, suffix_dedup.LENGTH)
    hits = suffix_dedup.bucket_hits(suffix_dedup.numbered(frame(spark, docs)), suffix_dedup.LENGTH, suffix_dedup.GRAM).where("open")
    of_bucket = {}
    for r in hits.collect():
        of_bucket.setdefault(r.bucket, []).append((r.doc, r.start, r.n))
    texts = dict(docs)
    for held in of_bucket.values():
        one_byte = all(len(set(texts[d][x:x + n + 99])) == 1 for d, x, n in held)
        assert one_byte or sum(n + 99 for _, _, n in held) <= bound
    assert of_bucket


def test_substrings_repeated_ids(spark):
    t = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(120))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed > 0) for r in suffix_dedup.remove_repeats(
        frame(spark, [(3, t), (3, t), (None, t), (5, None), (5, None)])).collect())
    assert got == [(-1, False), (3, True), (3, True), (5, False), (5, False)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_windows_are_classed_by_their_bytes():
    import numpy as np
    rng = random.Random(9)
    text = np.frombuffer("".join(rng.choice("ab") for _ in range(4000)).encode() * 2, np.uint8)
    at = np.arange(len(text) - 100)
    got, number = suffix_dedup.classes(text, at, 100)
    raw = text.tobytes()
    by = {}
    for i in at.tolist():
        by.setdefault(raw[i:i + 100], []).append(i)
    assert sorted(got.tolist()) == sorted(i for v in by.values() if len(v) > 1 for i in v)
    names = {}
    for i, k in zip(got.tolist(), number.tolist()):
        assert names.setdefault(k, raw[i:i + 100]) == raw[i:i + 100]
    assert len(set(names.values())) == len(names)
