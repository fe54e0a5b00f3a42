"""Line pairs for language-model training (rows 11, 53, 59-61, 65, 89, 91).

* consecutive lines (59): a self join on (file, line_no + 1): unique keys, no skew
  even when one file holds a third of all lines (no window over a file);
* global line buckets (60): per-file line counts, a two-level prefix sum over one
  row per file gives each file's offset; bucket = global line number div period;
* greedy unique pairs (61): per bucket (at most ``period`` pairs, a bounded group)
  an ordered fold keeps a pair only if its left text was not yet a left and its
  right text not yet a right; rejected pairs leave no trace;
* shards (11): pair_seq = dense position of accepted pairs; shard = pair_seq div n.

Pairs are found, accepted and numbered by digests of their lines (128 bits of SHA-256); texts travel once to the task of
their bucket or shard (``deal_lines``), where a line serves the pair that it begins and the one that it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOKEN_CLS, TOKEN_MASK, TOKEN_SEP
from ..session import cut_lineage, shuffles_go
from .ordering import cpu_partitions, dense_index, running_sum_max
from .wordpiece import cut_pair


def consecutive_lines(lines: DataFrame, file_col: str = "doc_id", no_col: str = "line_no",
                      line_col: str = "line_contents") -> DataFrame:
    """Row 59: ``file, line_no, left, right`` for each line and its successor."""
    nxt = lines.select(F.col(file_col), (F.col(no_col) - 1).alias(no_col), F.col(line_col).alias("right"))
    return lines.select(F.col(file_col), F.col(no_col), F.col(line_col).alias("left")).join(nxt, [file_col, no_col])


def line_offsets(lines: DataFrame, file_col: str = "doc_id", file_order: list[str] | None = None) -> DataFrame:
    """Per file: ``file_col, offset`` = lines in all earlier files (file order)."""
    per = lines.groupBy(file_col).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(c) for c in (file_order or [file_col])]
    s = running_sum_max(per, order, "_n", "_S", "_M")
    return s.select(file_col, (F.col("_S") - F.col("_n")).alias("offset"))


def line_buckets(lines: DataFrame, period: int = 64, file_col: str = "doc_id", no_col: str = "line_no") -> DataFrame:
    """Row 60: ``file, line_no, gidx, bucket`` (gidx from 0 across files in file order)."""
    off = line_offsets(lines, file_col)
    out = lines.select(file_col, no_col).join(off, file_col)
    gidx = F.col("offset") + F.col(no_col) - 1
    return out.select(file_col, no_col, gidx.alias("gidx"), F.floor(gidx / period).cast("long").alias("bucket"))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Row 61: ``pairs`` has ``bucket, gidx, left, right``; returns the accepted ones, with their other columns.  A
    bucket's pairs are brought together once and come out of there; the pairs are not made and joined a second time."""
    more = [c for c in pairs.columns if c not in ("bucket", "gidx", "left", "right")]
    grouped = pairs.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("gidx", "left", "right", *more))).alias("_p"))
    texts = [F.array().cast(f"array<{pairs.schema[c].dataType.simpleString()}>").alias(n) for c, n in (("left", "ls"), ("right", "rs"))]
    init = F.struct(*texts, F.array().cast("array<long>").alias("acc"))

    def step(st, x):
        ok = ~F.array_contains(st["ls"], x["left"]) & ~F.array_contains(st["rs"], x["right"])
        return F.struct(F.when(ok, F.concat(st["ls"], F.array(x["left"]))).otherwise(st["ls"]).alias("ls"),
                        F.when(ok, F.concat(st["rs"], F.array(x["right"]))).otherwise(st["rs"]).alias("rs"),
                        F.when(ok, F.concat(st["acc"], F.array(x["gidx"]))).otherwise(st["acc"]).alias("acc"))

    told = grouped.where(F.col("bucket").isNotNull()).select("bucket", F.aggregate("_p", init, step)["acc"].alias("_acc"), "_p")
    each = told.select("bucket", "_acc", F.explode_outer("_p").alias("_x")).where(F.array_contains("_acc", F.col("_x.gidx")))
    return each.select(*[F.col("bucket") if c == "bucket" else F.col("_x").getField(c).alias(c) for c in pairs.columns])


def digest(text: Column) -> Column:
    """128 bits of a text's SHA-256; null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def generate_pairs(lines: DataFrame, period: int = 64, file_col: str = "doc_id", no_col: str = "line_no",
                   line_col: str = "line_contents", texts: bool = True) -> DataFrame:
    """Rows 59-61: accepted ``file, line_no, left, right, gidx, bucket``; without ``texts``, ``left`` and ``right`` are
    digests of the lines."""
    told = cut_lineage(lines.select(file_col, no_col, digest(F.col(line_col)).alias(line_col)))
    cons = consecutive_lines(told, file_col, no_col, line_col)
    b = line_buckets(told, period, file_col, no_col)
    pairs = cut_lineage(unique_pairs(cons.join(b, [file_col, no_col])))  # numbering reads them twice
    return with_texts(pairs, lines, "bucket", file_col, no_col, line_col) if texts else pairs


def deal_lines(pairs: DataFrame, lines: DataFrame, by: str, file_col: str = "doc_id", no_col: str = "line_no",
               line_col: str = "line_contents", dealt: bool = True) -> DataFrame:
    """Every line that a pair of ``pairs`` (``file, line_no`` of its left line, and more) has, once for each value of
    ``by``, in that value's task (if ``dealt``): ``by, line`` and ``_of``, the pairs' rows with ``_right`` (whether it ends
    the pair; then only the row's number and its digest are told)."""
    def role(right: bool) -> DataFrame:
        at = (F.col(no_col) + int(right)).cast(pairs.schema[no_col].dataType).alias(no_col)
        told = [c if c in ("pair_seq", "_row", "right" if right else "left") or not right and c != "right" else
                F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in pairs.columns if c != by]
        told = [F.substring(c, 1, 8).alias(c) if isinstance(c, str) and c in ("left", "right") else c for c in told]  # only lines of one place are told apart
        return pairs.select(file_col, at, by, F.struct(*told, F.lit(right).alias("_right")).alias("_x"))

    of = role(False).unionByName(role(True)).repartition(file_col, no_col).groupBy(file_col, no_col, by).agg(F.collect_list("_x").alias("_of"))
    got = lines.select(file_col, no_col, line_col).join(of, [file_col, no_col]).select(by, line_col, "_of")
    return got.repartition(cpu_partitions(lines), by) if dealt else got


def with_texts(pairs: DataFrame, lines: DataFrame, by: str = "shard", file_col: str = "doc_id", no_col: str = "line_no",
               line_col: str = "line_contents") -> DataFrame:
    """``pairs`` with the lines themselves for their digests ``left`` and ``right``, dealt by ``by``."""
    # each row of pairs has a number; of lines that have one place the pair's own one is told by its digest
    row = "pair_seq" if "pair_seq" in pairs.columns else "_row"
    # both roles are made of one set of rows; numbered ones are read from a stored table as they are
    told = pairs if row == "pair_seq" else cut_lineage(pairs.withColumn("_row", F.monotonically_increasing_id()))
    got = cut_lineage(deal_lines(told, lines, by, file_col, no_col, line_col, dealt=False))
    each = got.repartition(cpu_partitions(lines), by).select(by, line_col, digest(F.col(line_col)).alias("_digest"), F.explode("_of").alias("_x"))
    text = lambda c, right: F.first(F.when((F.col("_x._right") == right) & (F.substring("_digest", 1, 8) == F.col(f"_x.{c}")), F.col(line_col)), True).alias(f"_{c}")
    more = [c for c in pairs.columns if c not in (by, row, "left", "right")]
    kept = [F.first(F.when(~F.col("_x._right"), F.col("_x").getField(c)), True).alias(f"_{c}") for c in more]
    own = each.groupBy(by, F.col("_x").getField(row).alias(f"_{row}")).agg(text("left", False), text("right", True), *kept)
    return own.select(*[F.col(by if c == by else f"_{c}").alias(c) for c in pairs.columns])


def shard_pairs(pairs: DataFrame, per_shard: int = 10000) -> DataFrame:
    """Row 11: ``pair_seq`` (dense, in gidx order) and ``shard = pair_seq div n``."""
    seq = dense_index(pairs, [F.col("gidx")], "pair_seq")
    return seq.withColumn("shard", F.floor(F.col("pair_seq") / per_shard).cast("long"))


def write_shards(pairs: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", dealt: bool = False) -> None:
    """Row 11 sink: one folder per shard (``shard=i``); rows of shard i are pairs
    [i*n, (i+1)*n).  Pairs that lie by shard already (``dealt``) do not travel once more."""
    rows = pairs if dealt else pairs.repartition("shard")
    w = rows.write.mode(mode).partitionBy("shard").format(fmt)
    with shuffles_go(pairs.sparkSession):
        (w.option("compression", "zstd") if fmt == "parquet" else w).save(path)


def _h(*parts: Column) -> Column:
    """md5 of the parts joined by '|', first 8 hex digits as a number (shared with the oracle)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def epoch_order(shards: DataFrame, epochs: int, seed: int = 0) -> DataFrame:
    """Row 65: per epoch, the shards in a reshuffled order: ``epoch, shard, position``
    (order by md5(seed | epoch | shard)); one row per (epoch, shard)."""
    from pyspark.sql import Window
    e = shards.select("shard").distinct().select("shard", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    e = e.withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"),
                                             F.col("shard").cast("string"))))
    return e.select("epoch", "shard", (F.row_number().over(Window.partitionBy("epoch").orderBy("_k")) - 1)
                    .cast("int").alias("position"))


def masked_examples(pairs: DataFrame, vocab_size: int, special: dict[str, int], seq_len: int = 128, seed: int = 0,
                    mask_rate: float = 0.15, mask_mask_rate: float = 0.8, mask_random_rate: float = 0.1, swap_rate: float = 0.5) -> DataFrame:
    """Row 91: training examples of ``seq_len`` places from encoded pairs (``pair_seq, shard, left_ids, right_ids``):
    ``pair_seq, is_next, token_ids, segment_ids, target_ids, masked`` (flags), cut as pairs are encoded (the longer side
    first) and padded with 0.  ``special``: ids of [CLS], [SEP] and [MASK].  Hashes replace the random draws:

    * swap: pairs with hash(seed|s|pair) < swap_rate take the right line of the next
      pair of the same shard (cyclic) and get ``is_next = 0``;
    * mask: a place i that is no [CLS] or [SEP] is chosen when hash(seed|m|pair|i) < mask_rate
      (at least one: the smallest hash when none is); a chosen id becomes [MASK]
      (80 %), an id picked by hash (10 %) or stays (10 %)."""
    scale = float(2 ** 32)
    swap = _h(F.lit(seed), F.lit("s"), F.col("pair_seq")) / scale < swap_rate
    # a side's ids beyond seq_len - 3 are never in an example: the longer side is cut first
    pairs = pairs.select("pair_seq", "shard", *[F.slice(c, 1, seq_len - 3).alias(c) for c in ("left_ids", "right_ids")])
    # next pair in the same shard, cyclic: a keyed self join (no window over a shard)
    sizes = pairs.groupBy("shard").agg(F.min("pair_seq").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    p = pairs.join(sizes, "shard")
    p = p.withColumn("_next", F.col("_lo") + (F.col("pair_seq") - F.col("_lo") + 1) % F.col("_n"))
    p = p.join(pairs.select(F.col("pair_seq").alias("_next"), F.col("right_ids").alias("_other")), "_next")
    p = p.select("pair_seq", "left_ids", F.when(swap, 0).otherwise(1).alias("is_next"), F.when(swap, F.col("_other")).otherwise(F.col("right_ids")).alias("_right"))
    cls, sep, mask = (special[t] for t in (TOKEN_CLS, TOKEN_SEP, TOKEN_MASK))
    cut_left, cut_right = cut_pair(F.col("left_ids"), F.col("_right"), seq_len)
    p = p.select("pair_seq", "is_next", cut_left.alias("_a"), cut_right.alias("_b"))
    whole = F.concat(F.array(F.lit(cls)), F.col("_a"), F.array(F.lit(sep)), F.col("_b"), F.array(F.lit(sep)))
    segments = F.concat(F.array_repeat(F.lit(0), F.size("_a") + 2), F.array_repeat(F.lit(1), F.size("_b") + 1))
    p = p.select("pair_seq", "is_next", whole.alias("_t"), segments.alias("_s"))
    p = p.withColumn("_h", F.transform("_t", lambda t, i: F.when(~t.isin(cls, sep), _h(F.lit(seed), F.lit("m"), F.col("pair_seq"), i) / scale)))
    p = p.withColumn("_min", F.array_min(F.filter("_h", lambda x: x.isNotNull())))
    p = p.withColumn("_c", F.transform("_h", lambda x: F.coalesce((x < mask_rate) | (x == F.col("_min")), F.lit(False)).cast("int")))

    def put(t, i):
        draw = _h(F.lit(seed), F.lit("k"), F.col("pair_seq"), i) / scale
        return F.when(F.get("_c", i) == 0, t).when(draw < mask_mask_rate, F.lit(mask)) \
            .when(draw < mask_mask_rate + mask_random_rate, (_h(F.lit(seed), F.lit("r"), F.col("pair_seq"), i) % vocab_size).cast("int")).otherwise(t)

    def padded(col: Column) -> Column:
        return F.concat(col, F.array_repeat(F.lit(0), F.lit(seq_len) - F.size(col)))
    return p.select("pair_seq", "is_next", padded(F.transform("_t", put)).alias("token_ids"), padded(F.col("_s")).alias("segment_ids"),
                    padded(F.col("_t")).alias("target_ids"), padded(F.col("_c")).alias("masked"))
