"""Learning and scoring on tables (rows 21, 31, 93-98, 106).

The reference fine-tunes a neural network.  Here the contract is kept (labelled
rows in, scored rows out, same thresholds and output columns) and the learner is
a multinomial naive Bayes model, which Spark computes by aggregation:

* model table ``token, n0, n1`` (token counts per class) plus one row with
  ``token = NULL`` holding the number of training rows per class (the priors);
* continuing from an earlier model adds counts (``base``);
* scoring adds up token weights where the rows are (``TokenWeights``): the weights
  of the most frequent tokens go to every task, so neither all tokens nor a token
  that holds a third of them are shuffled; only tokens beyond those meet the rest
  of the table in a join.

Comment models (purpose and every subject) are one table of counts per (target,
class, token), made in one pass and scored in one pass.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import vocab_tokens
from ..session import cut_lineage
from .labels import decode_purpose
from .ordering import explode_rows

#: Tokens whose weights go to every task, and the longest token among them (in characters).
HEAD_TOKENS = 1 << 18
HEAD_LENGTH = 128


def decide(score, threshold: float = 0.5, strict: bool = False) -> Column:
    """Row 21: lines use ``score >= t`` (strict=False); subjects use ``score > t``."""
    s = F.col(score) if isinstance(score, str) else score
    return ((s > threshold) if strict else (s >= threshold)).cast("int")


def _priors(model: DataFrame):
    r = model.where(F.col("token").isNull()).agg(F.sum("n0").alias("p0"), F.sum("n1").alias("p1")).first()
    return float(r["p0"] or 0.0), float(r["p1"] or 0.0)


def train_binary(df: DataFrame, text_col: str, label_col: str, weight_instances: bool = False,
                 base: DataFrame | None = None, tokenizer=None) -> DataFrame:
    """Row 93: naive Bayes model of P(label=1 | tokens of text).

    Returns ``token, n0, n1`` (doubles; a NULL token row holds the row counts per
    class).  ``base`` (an earlier model) adds its counts.  ``weight_instances``
    scales each class by its balanced weight (row 42)."""
    tok = tokenizer or vocab_tokens
    rows = df.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("_y"), tok(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    counts = (explode_rows(rows, ["_y"], F.col("_t"), "token")
              .groupBy("token").agg(F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("double").alias("n0"),
                                    F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("double").alias("n1")))
    priors = rows.agg(F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("double").alias("n0"),
                      F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("double").alias("n1")) \
        .select(F.lit(None).cast("string").alias("token"), "n0", "n1")
    model = counts.unionByName(priors)
    if base is not None:
        model = model.unionByName(base.select("token", "n0", "n1")) \
            .groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    if weight_instances:
        p0, p1 = _priors(model)
        k = (p0 > 0) + (p1 > 0)
        w0 = (p0 + p1) / (k * p0) if p0 else 0.0
        w1 = (p0 + p1) / (k * p1) if p1 else 0.0
        model = model.select("token", (F.col("n0") * w0).alias("n0"), (F.col("n1") * w1).alias("n1"))
    return model


def model_totals(model: DataFrame) -> dict:
    """Class totals of a binary model in one pass: token counts N0/N1, vocabulary
    size V and row counts p0/p1 (five scalars for the driver)."""
    tok = F.col("token").isNotNull()
    t = model.agg(F.sum(F.when(tok, F.col("n0"))).alias("N0"), F.sum(F.when(tok, F.col("n1"))).alias("N1"),
                  F.count(F.when(tok, 1)).alias("V"), F.sum(F.when(~tok, F.col("n0"))).alias("p0"),
                  F.sum(F.when(~tok, F.col("n1"))).alias("p1")).first()
    return {k: float(t[k] or 0.0) for k in ("N0", "N1", "V", "p0", "p1")}


_heads: dict[str, dict[str, int]] = {}


class TokenWeights:
    """``token`` -> one number per column of ``cols``; unknown tokens weigh nothing.

    ``table``: the stored weights; the ``HEAD_TOKENS`` tokens with the largest ``n`` are broadcast; ``whole`` tells that
    these are all."""

    def __init__(self, weights: DataFrame, cols: list[str]):
        self.cols = cols
        self.table = cut_lineage(weights.where(F.col("token").isNotNull()).select("token", "n", *cols))
        seen = self.table.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
        head = self.table.where(F.length("token") <= HEAD_LENGTH)
        if seen["rows"] > HEAD_TOKENS:  # so that at most 2 * HEAD_TOKENS meet in the selection
            head = head.where(F.col("n") * (2 * HEAD_TOKENS) >= seen["n"]).orderBy(F.col("n").desc(), "token").limit(HEAD_TOKENS)
        rows = head.select("token", *cols).collect()  # at most HEAD_TOKENS short tokens
        self.whole = len(rows) == seen["rows"]
        values = np.array([[r[c] for c in cols] for r in rows], np.float64).reshape(-1, len(cols))
        self.head = weights.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], values))
        self.key = uuid.uuid4().hex


def _adder(key: str, head, words: str, names: list[str], whole: bool):
    """Per row the sums of its known tokens, and the tokens that the head does not know."""
    def run(batches):
        tokens, values = head.value
        if key not in _heads:
            _heads.clear()
            _heads[key] = {t: i for i, t in enumerate(tokens)}
        place = _heads[key]
        padded = np.vstack([values, np.zeros((1, len(names)))])
        for b in batches:
            at = b.schema.get_field_index(words)
            flat = b.column(at).flatten().dictionary_encode()
            known = np.array([place.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
            index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            of = known[index] if len(index) else index
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column(at).offsets)))
            sums = [pa.array(np.bincount(row, padded[of, j], b.num_rows), pa.float64()) for j in range(len(names))]
            left = []
            if not whole:
                rest = of < 0
                sizes = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=b.num_rows))]).astype(np.int32)
                left = [pa.ListArray.from_arrays(pa.array(sizes), flat.filter(pa.array(rest)).dictionary_decode())]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *sums, *left],
                                             [*(b.schema.names[i] for i in keep), *names, *(["_left"] if left else [])])
    return run


def token_sums(df: DataFrame, words: Column, weights: TokenWeights) -> DataFrame:
    """``df`` with, for every column of ``weights``, the sum over the row's tokens (0 for a row without known ones)."""
    fields = [*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in weights.cols)]
    src = df.select("*", F.coalesce(words, F.array().cast("array<string>")).alias("_words"))
    if weights.whole:
        return src.mapInArrow(_adder(weights.key, weights.head, "_words", weights.cols, True), T.StructType(fields))
    fields.append(T.StructField("_left", T.ArrayType(T.StringType())))
    got = src.mapInArrow(_adder(weights.key, weights.head, "_words", weights.cols, False), T.StructType(fields))
    got = cut_lineage(got.withColumn("_row", F.monotonically_increasing_id()))
    left = got.select("_row", F.explode("_left").alias("token"))  # dealt once, by the token
    more = left.join(weights.table, "token").groupBy("_row").agg(*[F.sum(c).alias("_m_" + c) for c in weights.cols])
    out = got.join(more, "_row", "left")
    return out.select(*df.columns, *[(F.col(c) + F.coalesce("_m_" + c, F.lit(0.0))).alias(c) for c in weights.cols])


class LineScorer:
    """A binary model (row 93) made ready for scoring: stored log ratios per token, and the log ratio of the classes."""

    def __init__(self, model: DataFrame, alpha: float = 1.0):
        t = model_totals(model)
        N0, N1, V, p0, p1 = t["N0"], t["N1"], t["V"], t["p0"], t["p1"]
        w = F.log((F.col("n1") + alpha) / F.lit(N1 + alpha * V)) - F.log((F.col("n0") + alpha) / F.lit(N0 + alpha * V))
        self.weights = TokenWeights(model.select("token", (F.col("n0") + F.col("n1")).alias("n"), w.alias("_w")), ["_w"])
        self.prior = F.log(F.lit(p1) / F.lit(p0 + p1)) - F.log(F.lit(p0) / F.lit(p0 + p1))

    def score(self, df: DataFrame, text_col: str, tokenizer=None, out_col: str = "score") -> DataFrame:
        tok = tokenizer or vocab_tokens
        s = token_sums(df, tok(F.coalesce(F.col(text_col), F.lit(""))), self.weights)
        return s.withColumn(out_col, 1.0 / (1.0 + F.exp(-(F.col("_w") + self.prior)))).drop("_w")


def line_scorer(model) -> LineScorer:
    return model if isinstance(model, LineScorer) else LineScorer(model)


def score_binary(df: DataFrame, text_col: str, model, id_cols: list[str],
                 tokenizer=None, out_col: str = "score") -> DataFrame:
    """Row 94 core: ``id_cols + [out_col]`` = P(label = 1 | text); tokens unseen in training are ignored."""
    rows = df.select(*id_cols, F.col(text_col).alias("_text"))
    return line_scorer(model).score(rows, "_text", tokenizer, out_col).drop("_text")


def classify_lines(df: DataFrame, model, id_cols: list[str] | None = None, line_col: str = "line_contents",
                   threshold: float = 0.5, tokenizer=None) -> DataFrame:
    """Row 94: the input columns plus ``commented_prob`` and ``commented_pred`` (p >= t).  ``model``: a table of
    ``train_binary``, or a ``LineScorer`` made of one before."""
    return line_scorer(model).score(df, line_col, tokenizer, "commented_prob") \
        .withColumn("commented_pred", decide("commented_prob", threshold))


def train_multiclass(df: DataFrame, text_col: str, label_col: str, labels: list[str], tokenizer=None) -> DataFrame:
    """Purpose model (row 95): ``token, label, n`` token counts per label; a NULL
    token row per label holds its number of training rows."""
    tok = tokenizer or vocab_tokens
    rows = df.where(F.col(label_col).isin(list(labels))).select(
        F.col(label_col).alias("label"), tok(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    counts = explode_rows(rows, ["label"], F.col("_t"), "token").groupBy("token", "label") \
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    priors = rows.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n")) \
        .select(F.lit(None).cast("string").alias("token"), "label", "n")
    return counts.unionByName(priors)


def score_multiclass(df: DataFrame, text_col: str, model: DataFrame, labels: list[str], id_cols: list[str],
                     tokenizer=None, alpha: float = 1.0) -> DataFrame:
    """``id_cols + [scores]``: per-label posterior probabilities, in label order.

    log P(l | x) = log prior_l + sum_t c_t log(n_tl + a) - C log(N_l + a V), t over
    tokens seen in training (C their count).  Only the sparse (token, label) counts
    are joined; label constants are literals (the label list is fixed and small)."""
    tok = tokenizer or vocab_tokens
    L = len(labels)
    toks = model.where(F.col("token").isNotNull())
    N = {r["label"]: float(r["N"]) for r in toks.groupBy("label").agg(F.sum("n").alias("N")).collect()}  # <= L rows
    P = {r["label"]: float(r["n"]) for r in model.where(F.col("token").isNull()).collect()}  # <= L rows
    V = float(toks.select("token").distinct().count())
    tp = sum(P.values())
    lab_idx = F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(l), F.lit(i))])
    vocab = toks.select("token").distinct()
    sparse = toks.select("token", lab_idx[F.col("label")].alias("li"),
                         (F.log(F.col("n") + alpha) - F.log(F.lit(alpha))).alias("g"))
    t = explode_rows(df, id_cols, tok(F.coalesce(F.col(text_col), F.lit(""))), "token")
    tc = t.groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("_c")).join(vocab, "token", "left_semi")
    C = tc.groupBy(*id_cols).agg(F.sum("_c").alias("_C"))
    S = tc.join(sparse, "token").groupBy(*id_cols, "li").agg(F.sum(F.col("g") * F.col("_c")).alias("_S")) \
        .groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("li", "_S"))).alias("_m"))
    ids = df.select(*id_cols).distinct()
    j = ids.join(C, id_cols, "left").join(S, id_cols, "left")
    lp = [float("-inf") if not P.get(l) else math.log(P[l] / tp) for l in labels]
    lnorm = [math.log(N.get(l, 0.0) + alpha * V) for l in labels]
    ll = F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: (
        F.element_at(F.array(*[F.lit(x) for x in lp]), i + 1)
        + F.coalesce(F.col("_C"), F.lit(0)) * (F.lit(math.log(alpha))
                                               - F.element_at(F.array(*[F.lit(x) for x in lnorm]), i + 1))
        + F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0))))
    j = j.select(*id_cols, ll.alias("_ll"))
    j = j.withColumn("_mx", F.array_max("_ll"))
    j = j.withColumn("_e", F.transform("_ll", lambda x: F.exp(x - F.col("_mx"))))
    j = j.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return j.select(*id_cols, F.transform("_e", lambda x: x / F.col("_z")).alias("scores"))


# --- comment models: purpose and subjects (rows 95, 96) -----------------------

PURPOSE = "purpose"


def _flag(subject: str) -> Column:
    return F.coalesce(F.col(subject).cast("double"), F.lit(0.0)).cast("int")


def train_comments(df: DataFrame, message_col: str, purpose_col: str, purposes: list[str], subjects: list[str],
                   base: DataFrame | None = None, tokenizer=None) -> DataFrame:
    """Row 95: ``target, class, token, n``: in how many places a token stands in comments of a class, for the purpose
    (comments with another or no purpose left out) and for every subject (null is 0); with a null token, the number of
    comments of the class.

    Tokens are grouped once, with one sum per class beside each other; that table is turned to rows afterwards.
    ``base``: an earlier model whose counts are added."""
    tok = tokenizer or vocab_tokens
    rows = df.select(F.col(purpose_col).alias("_p"), *[_flag(s).alias(f"_s{i}") for i, s in enumerate(subjects)],
                     tok(F.coalesce(F.col(message_col), F.lit(""))).alias("_t"))
    sums = [F.sum(F.when(F.col("_p") == p, 1).otherwise(0)).alias(f"_p{i}") for i, p in enumerate(purposes)]
    sums += [F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(subjects))] + [F.count(F.lit(1)).alias("_n")]
    keys = ["_p", *[f"_s{i}" for i in range(len(subjects))]]
    counts = explode_rows(rows, keys, F.col("_t"), "token").groupBy("token").agg(*sums)
    every = counts.unionByName(rows.agg(*sums).withColumn("token", F.lit(None).cast("string")))
    cells = [(PURPOSE, p, F.col(f"_p{i}")) for i, p in enumerate(purposes)]
    cells += [(s, c, n) for i, s in enumerate(subjects) for c, n in (("0", F.col("_n") - F.col(f"_s{i}")), ("1", F.col(f"_s{i}")))]
    tall = every.select("token", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("class"), n.cast("double").alias("n"))
                                                     for t, c, n in cells])).alias("x"))
    model = tall.select("x.target", "x.class", "token", "x.n").where(F.col("n") > 0)
    if base is not None:
        model = model.unionByName(base.select("target", "class", "token", "n")) \
            .groupBy("target", "class", "token").agg(F.sum("n").alias("n"))
    return model


class CommentScorer:
    """A comment model made ready for scoring all targets at once: per token one weight per purpose, one whether it is
    known to the purpose, and the log ratio of every subject."""

    def __init__(self, model: DataFrame, purposes: list[str], subjects: list[str], alpha: float = 1.0):
        self.purposes, self.subjects = purposes, subjects
        told = model.groupBy("target", "class").agg(F.sum(F.when(F.col("token").isNotNull(), F.col("n"))).alias("N"),
                                                    F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("P")).collect()
        N = {(r["target"], r["class"]): float(r["N"] or 0.0) for r in told}  # one row per class
        P = {(r["target"], r["class"]): float(r["P"] or 0.0) for r in told}
        of = lambda t, c: F.sum(F.when((F.col("target") == t) & (F.col("class") == c), F.col("n")).otherwise(0.0))
        names = [of(PURPOSE, p).alias(f"_p{i}") for i, p in enumerate(purposes)]
        names += [of(s, c).alias(f"_s{i}_{c}") for i, s in enumerate(subjects) for c in "01"]
        wide = cut_lineage(model.where(F.col("token").isNotNull()).groupBy("token").agg(*names, F.sum("n").alias("n")))
        held = F.lit(0.0)
        for i in range(len(purposes)):
            held = held + F.col(f"_p{i}")
        subject_n = [F.col(f"_s{i}_0") + F.col(f"_s{i}_1") for i in range(len(subjects))]
        sizes = wide.agg(F.count_if(held > 0).alias("p"), *[F.count_if(n > 0).alias(f"s{i}") for i, n in enumerate(subject_n)]).first()
        # a purpose's log likelihood, told apart by what is the same for all tokens (times their number)
        cols = {f"p{i}": F.when(held > 0, F.log(F.col(f"_p{i}") + alpha)).otherwise(0.0) for i in range(len(purposes))}
        cols["known"] = (held > 0).cast("double")
        for i, s in enumerate(subjects):
            odds = F.log((F.col(f"_s{i}_1") + alpha) / F.lit(N.get((s, "1"), 0.0) + alpha * sizes[f"s{i}"])) \
                - F.log((F.col(f"_s{i}_0") + alpha) / F.lit(N.get((s, "0"), 0.0) + alpha * sizes[f"s{i}"]))
            cols[f"s{i}"] = F.when(subject_n[i] > 0, odds).otherwise(0.0)
        self.weights = TokenWeights(wide.select("token", "n", *[c.cast("double").alias("_w_" + n) for n, c in cols.items()]),
                                    ["_w_" + n for n in cols])
        total = sum(P.get((PURPOSE, p), 0.0) for p in purposes)
        log = lambda x, y: math.log(x / y) if x and y else float("-inf")
        self.priors = [log(P.get((PURPOSE, p), 0.0), total) for p in purposes]
        self.norms = [math.log(N.get((PURPOSE, p), 0.0) + alpha * sizes["p"]) if sizes["p"] else 0.0 for p in purposes]
        yes, no = ([P.get((s, c), 0.0) for s in subjects] for c in "10")
        self.odds = [float("-inf") if not a else math.log(a / b) if b else float("inf") for a, b in zip(yes, no)]

    def score(self, df: DataFrame, message_col: str, tokenizer=None) -> DataFrame:
        """``df`` with ``purpose_scores`` (log likelihood per purpose) and one probability per subject (``prob_<s>``)."""
        tok = tokenizer or vocab_tokens
        s = token_sums(df, tok(F.coalesce(F.col(message_col), F.lit(""))), self.weights)
        likely = F.array(*[F.lit(self.priors[i]) + F.col(f"_w_p{i}") - F.col("_w_known") * F.lit(self.norms[i]) for i in range(len(self.purposes))])
        probs = [(1.0 / (1.0 + F.exp(-(F.col(f"_w_s{i}") + F.lit(self.odds[i]))))).alias("prob_" + x) for i, x in enumerate(self.subjects)]
        return s.select(*df.columns, likely.alias("purpose_scores"), *probs)


def classify_comments(df: DataFrame, message_col: str, model, purposes: list[str], subjects: list[str],
                      threshold: float = 0.5, tokenizer=None) -> DataFrame:
    """Row 96: the input columns, ``pred_purpose`` (the likeliest, the first of equals) and per subject ``prob_<s>`` and
    ``pred_<s>`` (probability above the threshold).  ``model``: a table of ``train_comments``, or its scorer."""
    scorer = model if isinstance(model, CommentScorer) else CommentScorer(model, purposes, subjects)
    s = scorer.score(df, message_col, tokenizer)
    return s.select(*df.columns, decode_purpose("purpose_scores", purposes).alias("pred_purpose"), *["prob_" + x for x in subjects],
                    *[decide("prob_" + x, threshold, strict=True).alias("pred_" + x) for x in subjects])


def attach_predictions(df: DataFrame, preds: DataFrame, id_cols: list[str]) -> DataFrame:
    """Row 31: predictions beside the input rows, matched on a row id (never on position)."""
    return df.join(preds, id_cols, "left")
