"""One large JSON document of nested lists, read by many tasks (rows 3, 12).

Spark's text source splits the file by bytes and cuts records at commas.  A comma is in the middle of a string or
between two elements; which one follows from the number of unescaped quotes before it.  Those, opened brackets and
elements are summed inside each file block and over blocks (one row per block), so every record knows its state
without anything reading the document from its start; records of one string are put together again by the element
they belong to.  A document may lie in the parts that Spark writes: the files of a folder, one after the other in order
of their names, cut anywhere but after a comma or a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _before(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<c>_to``: the sum of each of ``cols`` over all records of the document up to and with this one."""
    inside = Window.partitionBy("doc", "part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("doc").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("doc", "part", "block").agg(*[F.sum(c).alias(c) for c in cols])  # one row per block of a file
    blocks = blocks.select(F.col("doc").alias("_d"), F.col("part").alias("_p"), F.col("block").alias("_b"),
                           *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in cols])
    out = df.withColumns({f"{c}_in": F.sum(c).over(inside) for c in cols})
    out = out.join(F.broadcast(blocks), (F.col("doc") == F.col("_d")) & (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")))
    return out.withColumns({f"{c}_to": F.col(f"{c}_in") + F.col(f"{c}_off") for c in cols}) \
        .drop("_d", "_p", "_b", *[f"{c}_in" for c in cols], *[f"{c}_off" for c in cols])


def elements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """One row per element that is no list, and per empty list: ``doc`` (the file; with ``parts`` the folder), ``place`` (its
    number in the document, from 1), ``opened`` (brackets opened up to it) and ``text`` (its JSON; empty for an empty list)."""
    file = F.col("_metadata.file_path")
    raw = spark.read.option("lineSep", ",").text(path).select(
        "value", (F.lit(path) if parts else file).alias("doc"),
        (F.substring_index(file, "/", -1) if parts else F.lit("")).alias("part"), F.col("_metadata.file_block_start").alias("block"))
    masked = F.regexp_replace("value", r"\\.", "__")
    raw = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("masked", masked)
    raw = cut_lineage(raw.withColumn("quotes", F.regexp_count("masked", F.lit('"')).cast("long")))
    # no comma stands before the first record of a later part: it goes on with the element that the part before ends in
    heads = raw.where("block = 0").groupBy("doc", "part").agg(F.min("at").alias("at"))  # one row per file
    first = heads.groupBy("doc").agg(F.min("part").alias("_first"))
    heads = heads.join(F.broadcast(first), "doc").where(F.col("part") > F.col("_first")).select("at", F.lit(True).alias("_head"))
    joined = F.coalesce("_head", F.lit(False))
    inside = (F.col("quotes_to") - F.col("quotes")) % 2 == 1
    outer = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), F.col("masked"))).otherwise(F.col("masked")), r'"[^"]*("|$)', "")
    told = _before(raw, ["quotes"]).join(F.broadcast(heads), "at", "left").select(
        "doc", "part", "block", "at", "value", joined.alias("joined"), F.when(inside | joined, 0).otherwise(1).cast("long").alias("starts"),
        (F.length(outer) - F.length(F.replace(outer, F.lit("["), F.lit("")))).cast("long").alias("opens"))
    placed = _before(cut_lineage(told), ["starts", "opens"])
    records = F.array_sort(F.collect_list(F.struct("part", "block", "at", "joined", "value")))  # the records of one element
    got = placed.groupBy("doc", F.col("starts_to").alias("place")).agg(F.max("opens_to").alias("opened"), records.alias("records"))
    whole = F.array_join(F.transform("records", lambda r, i: F.concat(F.when((i == 0) | r["joined"], "").otherwise(","), r["value"])), "")
    return got.select("doc", "place", "opened", F.regexp_replace(whole, r"^[\s\[\]]+|[\s\[\]]+$", "").alias("text"))


def string_of(text: Column) -> Column:
    """The string that a JSON element is; null for the element null."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def read_lists_of_strings(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """A document ``[[string, ...], ...]`` as ``file_no`` (from 0, in each document), ``line_no`` (from 0), ``line``."""
    own = cut_lineage(elements(spark, path, parts).where(F.col("text") != "")
                      .select("doc", "place", (F.col("opened") - 2).alias("file_no"), string_of(F.col("text")).alias("line")))
    # places of empty lists are left out inside a document, so a line's number is its distance from its list's first
    first = own.groupBy("doc", "file_no").agg(F.min("place").alias("first"))
    return own.join(first, ["doc", "file_no"]).select("file_no", (F.col("place") - F.col("first")).cast("int").alias("line_no"), "line")


def read_lines_and_vectors(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Documents ``[[line, ...], [[number, ...], ...]]`` as ``line, embedding``, matched by position."""
    all_of = cut_lineage(elements(spark, path, parts))
    lines = all_of.where((F.col("opened") == 2) & (F.col("text") != ""))
    lines = lines.select("doc", (F.col("place") - 1).alias("i"), string_of(F.col("text")).alias("line"))
    numbers = all_of.where((F.col("opened") >= 4) & (F.col("text") != "")).select("doc", (F.col("opened") - 4).alias("i"), "place", "text")
    vectors = numbers.groupBy("doc", "i").agg(F.array_sort(F.collect_list(F.struct("place", F.col("text").cast("float").alias("x")))).alias("xs"))
    return lines.join(vectors, ["doc", "i"]).select("line", F.transform("xs", lambda v: v["x"]).alias("embedding"))
