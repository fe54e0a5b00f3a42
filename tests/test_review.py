"""Row 101: lines that share a vector are looked up once, and each line still gets its own row."""

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import similar as sm
from sightline.operators.hooks import batch_classifier, batch_embedder
from sightline.operators.learn import TokenWeights, token_sums
from sightline.plans.review import review


def test_equal_vectors_are_looked_up_once(spark, monkeypatch):
    lines = [("x" * (1 + i % 9), i) for i in range(60)] + [("plain", 60), (None, 61)]
    df = spark.createDataFrame(lines, "line_contents string, i int")
    refs = spark.createDataFrame([(0, "even", [0.0, 0.0]), (1, "odd", [1.0, 0.0]), (2, "far", [9.0, 9.0]), (3, "odd", [1.0, 0.0])],
                                 "ref_id long, line string, embedding array<float>")
    comments = spark.createDataFrame([("even", "e1", "p", 1.0, 1), ("odd", "o1", "p", 0.0, 2), ("odd", "o2", "q", 1.0, 3)],
                                     "line_contents string, message string, purpose string, s double, k int")
    def classifier():
        return lambda texts: np.array([float(t.startswith("x")) for t in texts.ravel()])

    def embedder():  # 0.0 and -0.0 are one vector
        return lambda texts: np.array([[len(t) % 2, 0.0 if len(t) % 4 < 2 else -0.0] for t in texts.ravel()], np.float32).reshape(-1, 2)

    asked, plain = [], sm.similar_pairs
    monkeypatch.setattr(sm, "similar_pairs", lambda q, *a, **k: (asked.append(q.count()), plain(q, *a, **k))[1])
    got = review(df, None, refs, comments, ["p", "q"], ["s"], ["i"], ["k"], classify_fn=batch_classifier(classifier),
                 embed_fn=batch_embedder(embedder)).collect()
    assert asked == [2]
    assert sorted(r["i"] for r in got) == list(range(62))
    for r in got:
        text = lines[r["i"]][0]
        if text is None or not text.startswith("x"):
            assert (r["decision"], r["messages"], r["no_comments"]) == (0, "", None)
        elif len(text) % 2:
            assert (r["no_similar_lines"], r["no_comments"], r["messages"], r["lines"], r["p"], r["q"], r["s"]) == \
                (1, 2, "o1 ||| o2", "odd ||| odd", 0.5, 0.5, 0.5)
        else:
            assert (r["no_similar_lines"], r["no_comments"], r["messages"], r["p"], r["s"]) == (1, 1, "e1", 1.0, 1.0)


def test_tail_tokens_count_as_often_as_they_occur(spark, monkeypatch):
    from sightline.operators import learn
    monkeypatch.setattr(learn, "HEAD_TOKENS", 1)
    weights = TokenWeights(spark.createDataFrame([("a", 9, 1.0), ("b", 1, 10.0), ("c", 1, 100.0)], "token string, n long, w double"), ["w"])
    assert not weights.whole
    df = spark.createDataFrame([(0, ["a", "b", "b", "z", "c"]), (1, []), (2, None), (3, ["z"]), (0, ["b"])], "i int, t array<string>")
    got = token_sums(df, F.col("t"), weights)
    assert sorted((r["i"], r["w"]) for r in got.collect()) == [(0, 10.0), (0, 121.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    exchanges = got._jdf.queryExecution().optimizedPlan().toString()
    assert exchanges.count("Aggregate [") == 1
