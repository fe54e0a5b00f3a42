"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table of (digest, keep_id, group_size), bucketed and sorted by digest, in the shared folder; its
number of buckets is written beside its files, so any later session opens the folder as the same table.  A batch
is reduced to one row per digest before any join, met with the index by a sort-merge join on the bucketed digest,
and the digests that the index lacks (a sort-merge anti-join) are appended.

Defined results: null text counts as empty; of equal texts in a batch the largest doc_id stays (null is the
smallest); of rows repeating that doc_id too, one stays; a text that an earlier batch brought in is dropped for the
doc_id that the index holds.  An empty batch changes nothing and returns no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage

SCHEMA = "text_sha256 string, keep_id long, group_size long"


class DigestIndex:
    """A digest index under ``path``; each append adds sorted files to every bucket.  A folder that holds an index is
    opened with the digests and the number of buckets that it has; without ``path`` the index is a new one."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        fresh = "digest_index_" + uuid.uuid4().hex
        place = self._path(path or f"{checkpoint_dir(spark).rstrip('/')}/sightline-tables/{fresh}")
        self.path = place.toString()
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        held = self._held(place)
        if held and buckets and buckets != held:
            raise ValueError(f"{self.path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        if not held:
            self._fs(place).mkdirs(place)
            self._fs(place).create(self._child(place, f"_buckets_{self.buckets}"), False).close()
        if spark.catalog.tableExists(self.name):
            if held:
                spark.catalog.refreshTable(self.name)
                return
            spark.sql(f"DROP TABLE {self.name}")  # the folder behind it is gone
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return self._fs(path).makeQualified(path)

    def _child(self, path, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path, name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _held(self, path) -> int:
        """The number of buckets of the index in a folder; 0 where there is none."""
        fs = self._fs(path)
        if not fs.exists(path):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        told = [int(x.rsplit("_", 1)[1]) for x in names if x.startswith("_buckets_")]
        if not told and any(not x.startswith(("_", ".")) for x in names):
            raise ValueError(f"{self.path} holds files but no digest index")
        return told[0] if told else 0

    def append(self, digests: DataFrame) -> None:
        (digests.select("text_sha256", "keep_id", "group_size").repartition(self.buckets, "text_sha256")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
         .option("path", self.path).saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def dedup_batch(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size (rows of this batch with the text), kept,
    text_sha256.  New digests are appended to ``index``; copies of indexed texts are not kept."""
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row_no")))
    groups = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_no")).alias("top"),
                                             F.count(F.lit(1)).alias("group_size"))
    groups = cut_lineage(groups)
    known = index.read().select("text_sha256", F.col("keep_id").alias("old_id"), F.lit(True).alias("known"))
    seen = cut_lineage(groups.join(known.hint("merge"), "text_sha256", "left"))
    fresh = groups.join(index.read().hint("merge"), "text_sha256", "left_anti")
    index.append(cut_lineage(fresh.select("text_sha256", F.col("top.doc_id").alias("keep_id"), "group_size")))
    # a hot digest is split here by adaptive skew handling: the other side has one row for it
    out = rows.join(seen.hint("merge"), "text_sha256")
    return out.select(
        "doc_id", F.when(F.col("known"), F.col("old_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), "group_size",
        (F.col("known").isNull() & (F.col("row_no") == F.col("top.row_no"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` (all columns) without the rows whose text another row of the batch, or the index, keeps.

    Digests alone are grouped and met with the index; then one semi join on the unique (digest, doc_id) of the rows
    that stay shuffles the texts, evenly whatever the groups' sizes.  Only where rows repeat such a pair, one row of
    each is picked in a further step.  Rows travel as one struct, so column names cannot clash."""
    index = index or DigestIndex(docs.sparkSession)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest)
    pairs = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("text_sha256").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "n")).alias("top"), F.sum("n").alias("group_size"))
    groups = groups.select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("n"), "group_size")
    fresh = cut_lineage(groups.join(index.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti"))
    index.append(fresh)
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), digest)
    stay = fresh.select(F.col("text_sha256").alias("of"), "keep_id")
    out = marked.join(stay, (F.col("text_sha256") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    if not fresh.where("n > 1").isEmpty():
        out = out.groupBy("text_sha256").agg(F.first("doc").alias("doc"))
    return out.select("doc.*")
