"""Language model, quality rules, toxicity, mixing: brute force, held-out accuracy, odd rows."""

import itertools
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from sightline.llm import mixing, pitman_yor, quality, toxicity  # noqa: E402
from sightline.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, row_no long, score double, n_words string"


def frame(spark, rows):
    """(doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 1, 0.5, "x") for r in rows], SCHEMA)


# --- quality -----------------------------------------------------------------

def odd_texts():
    rng = random.Random(4)
    v = ["ab", "c#", "Éà", "x.", "\x0b", "|", "q&q", " w", "long" * 9]
    out = [None, "", " \n\n ", "a b a b a b a", "x\nx\n x\nx", "a\r\na\r\n", "one two three", "a a a", "ok " * 60, "w" * 50_000]
    for _ in range(60):
        out.append("".join(rng.choice(v) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 90))))
    return out


def test_quality_counts(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, list(enumerate(texts)) + [(0, None)])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        want = brute.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.quality_report(frame(spark, [])).count() == 0


def test_quality_against_labels(spark):
    kept = quality.keep_good(table(spark, SF, "documents"))
    assert kept.columns == table(spark, SF, "documents").columns
    rows = quality.quality_report(table(spark, SF, "documents")).withColumnRenamed("quality", "p").join(table(spark, SF, "labels"), "doc_id").collect()
    junk, clean = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_quality_estimate_matches_enumeration():
    """Posterior of every pattern from the returned accuracies, vote by vote."""
    rng = np.random.default_rng(1)
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    n = rng.integers(1, 500, len(patterns)).astype(float)
    good, right = quality.estimate(patterns, n)
    assert ((good >= 0) & (good <= 1)).all()
    for p, g in zip(patterns, good):
        for j in range(3):
            if p[j] >= 0:
                q = p.copy()
                q[j] = -1
                assert good[(patterns == q).all(1)][0] <= g + 1e-9
    assert right.shape == (2, 3)


def test_quality_data_move_accuracies_and_overturn_a_vote():
    names = list(quality.RULES)
    one = lambda **v: [v.get(r, 0) for r in names]
    good = {r: 1 for r, x in quality.RULES.items() if x[2] == 1}
    table_like, junk = one(symbols=-1, **good), one(symbols=-1, varied_words=1)
    rest = [(one(**good), 5000), (one(shouting=-1, exclamations=-1), 150), (one(repeated_words=-1, repeated_lines=-1), 150)]
    told, right = {}, {}
    for name, tables in (("few", 1), ("many", 300)):
        rows = [*rest, (junk, 100), (table_like, tables)]
        p, r = quality.estimate(np.array([x for x, _ in rows]), np.array([k for _, k in rows], float))
        told[name], right[name] = dict(zip((tuple(x) for x, _ in rows), p)), r[0, names.index("symbols")]
    assert right["few"] > 0.9 and right["many"] < 0.5
    assert told["many"][tuple(table_like)] > 0.9
    assert all(t[tuple(junk)] < 0.1 and t[tuple(one(**good))] > 0.9 and t[tuple(rest[1][0])] < 0.1 for t in told.values())


def test_quality_single_votes_on_clean_texts(spark):
    """Non-Latin text with Latin acronyms is kept, beside junk that is dropped."""
    rng = random.Random(6)
    v = ["the", "of", "and", "to", "in"] * 8 + ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(3, 9))) for _ in range(120)]
    say = lambda k: " ".join(" ".join(rng.choice(v) for _ in range(9)) + "." for _ in range(k))
    clean = [say(9) for _ in range(300)]
    shout = [say(9).upper().replace(".", "!!") for _ in range(20)]
    marks = [" ".join(w + "###" for w in say(9).split()) for _ in range(20)]
    cyrillic = ["Это пример текста про СССР и " + "слова разные здесь идут подряд. " + " ".join(
        "".join(rng.choice("абвгдежзик") for _ in range(rng.randint(3, 8))) for _ in range(60)) + " NATO USA EU." for _ in range(20)]
    texts = clean + shout + marks + cyrillic
    kind = ["clean"] * 300 + ["shout"] * 20 + ["marks"] * 20 + ["cyrillic"] * 20
    rows = quality.quality_report(frame(spark, list(enumerate(texts)))).collect()
    share = {k: np.mean([r.kept for r in rows if kind[r.doc_id] == k]) for k in set(kind)}
    assert share["clean"] > 0.98 and share["cyrillic"] == 1 and share["shout"] == share["marks"] == 0, share


def test_letters_of_all_scripts():
    text = "aB1 éÉ жЖ 中文 𠀀 𝐀 ال ñ-ß"
    letter, upper = quality._letters(np.frombuffer(text.encode(), np.uint8))
    assert letter.sum() == sum(map(str.isalpha, text)) and upper.sum() == sum(map(str.isupper, text))


# --- mixing ------------------------------------------------------------------

def test_mix_targets_and_budgets(spark):
    rng = random.Random(8)
    rows = []
    for s, n in [("b", 300), ("a", 40), ("Z", 5), (None, 60), ("é", 20), ("empty", 3)]:
        for _ in range(n):
            rows.append((len(rows), None if s == "empty" else " ".join(["w"] * rng.randint(0, 30)), s))
    rows.append((0, "one more row of the first id", "b"))
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mix_of_rows_without_ids_of_their_own(spark, monkeypatch):
    """Null, repeated and wholly equal rows get keys of their own and spread over the ranges of a hot source."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 64)
    rows = [(None, "w " * (i % 9), "hot") for i in range(1500)] + [(7, "same text", "hot")] * 700 + [(i, "a b c", "cold") for i in range(50)]
    keyed = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(rows)], "row_no long, doc_id long, text string")
    keys = mixing.own_keys(keyed.select("row_no", "doc_id", F.xxhash64("doc_id", "text").alias("key")))
    assert keys.count() == keys.select("key").distinct().count() == len(rows)
    runs = [sorted((r.doc_id or -1, r.size, r.taken, r.target) for r in mixing.mix(frame(spark, rows).repartition(n)).collect()) for n in (3, 8)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    for source, size in (("hot", sum(len(t.split()) for _, t, s in rows if s == "hot")), ("cold", 150)):
        got = [r for r in mixing.mix(frame(spark, rows)).collect() if r.source == source]
        assert got[0].source_size == size and abs(sum(r.taken for r in got) - got[0].target) <= 1
        assert all(r.taken <= 2 * r.size for r in got)


def test_mixed_documents(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "ab"[i % 2]) for i in range(200)]
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "row_no", "score", "n_words"]
    times = {}
    for r in out.collect():
        assert r.text == rows[r.doc_id][1] and r.text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    words = {s: sum(n * len(brute.words(rows[d][1])) for d, n in times.items() if rows[d][2] == s) for s in "ab"}
    sizes = {s: sum(len(brute.words(t)) for _, t, x in rows if x == s) for s in "ab"}
    want = brute.targets(sizes)
    assert all(abs(words[s] - want[s]) <= 8 for s in "ab")


# --- language model ----------------------------------------------------------

def test_language_model_base_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 2000)
    rng = random.Random(2)
    v = ["the", "The", "of", "é", "é,", "lamp", "stone"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(v[: rng.choice([4, 207])]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n"), (3, "the the"), (None, "of é"), (903, "the " * 3000)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [t for d, t in rows if not held(d)]
    got = pitman_yor.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), held(d), *brute.unigram(train, t)) for d, t in rows)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for w, h in zip(want, have):
        assert w[:5] == h[:5] and h[5] == pytest.approx(w[5], rel=1e-12)
    assert all(r.score < 0 for r in got)
    assert pitman_yor.score(frame(spark, [])).count() == 0
    assert pitman_yor.score(frame(spark, [(1, "never seen")])).count() == 1


def test_language_model_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, in every context, for one part and its own totals."""
    rng = np.random.default_rng(3)
    part = pitman_yor.Part.__new__(pitman_yor.Part)
    n_words, contexts = 30, np.array([3, 9, 11])
    word, k = np.meshgrid(np.arange(n_words), contexts, indexing="ij")
    part.word, part.k, part.n_words = word.ravel(), k.ravel(), n_words
    part.count = rng.integers(0, 60, len(part.word)) * (rng.random(len(part.word)) < 0.4)
    part.count[part.word == 0] += 1
    part.of_word = np.bincount(part.word, part.count, n_words).astype(int)
    known = part.of_word > 0
    totals = pitman_yor.Totals([])
    totals.tokens, totals.vocabulary = part.count.sum(), int(known.sum())
    totals.tables += np.bincount(part.k, part.count > 0, pitman_yor.CONTEXTS)
    totals.parent_tables = totals.vocabulary
    seats = pitman_yor.sample(part, totals, (1, 1))
    assert (seats[0] <= part.count).all() and (seats[0] >= (part.count > 0)).all() and (seats[2] <= seats[1]).all()
    after = pitman_yor.Totals([])
    after.tokens, after.vocabulary = totals.tokens, totals.vocabulary
    after.customers += np.bincount(part.k, part.count, pitman_yor.CONTEXTS)
    after.tables += np.bincount(part.k, seats[0], pitman_yor.CONTEXTS)
    after.parent_tables = seats[2].sum()
    p = pitman_yor.probability(part, seats, after)
    for c in contexts:
        own = part.k == c
        unknown = p[own & ~known[part.word]]
        assert p[own & known[part.word]].sum() + (unknown[0] if len(unknown) else 0) == pytest.approx(1, abs=0.04 if not len(unknown) else 1e-9)


def test_every_context_has_a_restaurant_of_its_own(spark, monkeypatch):
    """More contexts than any fixed number of restaurants, one customer in each: all seats are certain, over all parts."""
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 20_000)
    n = 20_000
    in_training = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 != 1)
    apart = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    got = {r.doc_id: r for r in pitman_yor.score(frame(spark, [
        (in_training, " ".join(f"w{i}" for i in range(n))), (apart, "w7 w8 w3 nowhere")])).collect()}
    d1, s1, d0, s0 = pitman_yor.D1, pitman_yor.S1, pitman_yor.D0, pitman_yor.S0
    base = (s0 + d0 * (n + 1)) / (n + 2)  # the end is a word, and the unknown word is one more
    known, unknown = (1 - d0 + base) / (s0 + n + 1), base / (s0 + n + 1)
    seen = (1 - d1 + (s1 + d1) * known) / (s1 + 1)
    assert got[in_training].score == pytest.approx((n + 1) * math.log10(seen), rel=1e-9)
    after = (s1 + d1) * known / (s1 + 1)  # a known word in a context that has another
    # start w7, w7 w8 (seen), w8 w3, w3 nowhere, nowhere end (a context without customers)
    want = 2 * math.log10(after) + math.log10(seen) + math.log10((s1 + d1) * unknown / (s1 + 1)) + math.log10(known)
    assert got[apart].score == pytest.approx(want, rel=1e-9)


def test_seats_follow_the_restaurant():
    """The mean number of tables against the exact distribution, summed step by step."""
    rng = np.random.default_rng(0)
    for n, a, d in [(5, 0.7, 0.5), (30, 2.0, 0.8), (400, 3.0, 0.6)]:
        dist = {1: 1.0}
        for k in range(1, n):
            new = {}
            for t, p in dist.items():
                q = a / (a + k - d * t)
                new[t] = new.get(t, 0) + p * (1 - q)
                new[t + 1] = new.get(t + 1, 0) + p * q
            dist = new
        mean = sum(t * p for t, p in dist.items())
        got = pitman_yor.seat(np.full(4000, n), np.full(4000, a), d, rng).mean()
        assert abs(got - mean) < 0.06 * mean


def test_language_model_beats_base_on_held_out(spark):
    rows = [r for r in pitman_yor.score(table(spark, SF, "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.92 * sum(r.base_score for r in rows)
    assert not math.isnan(sum(r.score for r in rows))


# --- toxicity ----------------------------------------------------------------

def toxic_corpus(spark, n=500):
    rng = random.Random(6)
    bad = ["stinkhead", "grumblewort"]
    v = ["".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(v) for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad) if i % 2 else rng.choice(bad)[:-1] + rng.choice("xyz"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " "), (3, rows[3][1]), (None, "stinkheads"), (1003, "stinkhed " + " ".join(v * 60)), (1004, " ".join(v * 60))]
    return frame(spark, rows), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int"), dict(labels)


def test_windows_count_a_word_once():
    rng = random.Random(4)
    for size in (1, 2, 5):
        rows = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 3, 9]))] for _ in range(30)]
        doc = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
        which = np.array([w for r in rows for w in r], np.int64)
        x = np.random.default_rng(1).normal(size=4)
        old, toxicity.WINDOW = toxicity.WINDOW, size
        try:
            w = toxicity.Windows(doc, which)
        finally:
            toxicity.WINDOW = old
        want = [(i, sum(x[k] for k in set(r[a:a + size]))) for i, r in enumerate(rows) for a in range(max(1, len(r) - size + 1)) if r]
        got = w.sums(x[which])
        assert w.row.tolist() == [i for i, _ in want] and np.allclose(got, [v for _, v in want])
        g = np.random.default_rng(2).normal(size=len(got))
        assert np.isclose((got * g).sum(), (w.spread(g) * x[which]).sum())


def test_toxicity(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score < 0.5
    assert by[1003].predicted == 1 and by[1004].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(frame(spark, []), labels).count() == 0
    model, neutral = toxicity.fit(docs, labels), by[1004]
    told = {r.doc_id: r for r in docs.collect()}
    for n in range(1, 7):  # neutral words before a text leave its verdict and all but its first window alone
        moved = [(i, " ".join(told[1004].text.split()[:n]) + " " + told[i].text) for i in truth if truth[i]]
        after = dict(zip([i for i, _ in moved], toxicity.score_rows(toxicity.Chunk(None, np.frombuffer("".join(t for _, t in moved).encode(), np.uint8),
                     np.cumsum([0] + [len(t.encode()) for _, t in moved])), model)))
        assert all(after[i] >= by[i].score - 1e-9 for i in after) and neutral.predicted == 0
    assert {r.predicted for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0}
