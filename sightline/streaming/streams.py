"""Streams (rows 103, 104), re-aimed from the reference's paged HTTP pulling and
web form: review JSON lands in a folder; submitted lines land in a folder.

Both use ``trigger(availableNow=True)`` by default (process what is there, then
stop; restartable from the checkpoint), and ``foreachBatch`` sinks that are
idempotent per ``batch_id`` (a retried batch overwrites its own partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import parse_dates
from ..schemas import REVIEW_SCHEMA
from ..session import cut_lineage, release
from ..sources.readers import flatten_added_lines, flatten_comments


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    # idempotent: only this batch's partition is replaced
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("compression", "zstd") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


class SeenRevisions(StatefulProcessor):
    """Per change the revisions that came in so far: a row passes the first time its revision does.  With
    ``forget_after`` (seconds), a change that nothing came in for as long is forgotten by a timer."""

    def __init__(self, forget_after: int | None = None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "revision string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.forget_after is not None else 0
        for frame in rows:
            new = []
            for revision in frame["revision"]:
                first = not self.seen.containsKey((revision,))
                if first:
                    self.seen.updateValue((revision,), (now,))
                new.append(first)
            if any(new):
                yield frame[new]
        if self.forget_after is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + 1000 * self.forget_after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def ingest_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                  max_files_per_trigger: int | None = None, forget_after: int | None = None,
                  available_now: bool = True):
    """Row 103: new review files become rows of ``flatten_comments`` (``out/comments``)
    and ``flatten_added_lines`` (``out/added``) exactly once per change and revision: a
    change seen again brings in its new revisions only, however late.  What is kept is
    one small state per change (its revisions' names), in the state store of the stream's
    checkpoint; with ``forget_after`` (seconds, for a stream that runs on: timers keep it
    going) a change that nothing came in for as long is forgotten.  Records that do not parse, or have no id or no date, go to ``out/bad``."""
    if forget_after is not None and available_now:
        raise ValueError("timers need a stream that runs on: available_now=False")
    schema = T.StructType(REVIEW_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
    r = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.json(source_dir).withColumn("_ts", parse_dates(F.col("created")))
    usable = F.col("_corrupt").isNull() & F.col("id").isNotNull() & F.col("_ts").isNotNull()
    content = REVIEW_SCHEMA["revisions"].dataType.valueType
    good = s.where(usable).select("id", "created", F.explode("revisions").alias("revision", "content")) \
        .select("id", "created", "revision", F.to_json("content").alias("content"))
    good = good.groupBy("id").transformWithStateInPandas(SeenRevisions(forget_after), "id string, created string, revision string, content string",
                                                         "Append", "None" if forget_after is None else "ProcessingTime")

    def handle(batch: DataFrame, batch_id: int) -> None:
        told = cut_lineage(batch)  # both sinks read what came through once
        batch = told.select("id", "created", F.create_map("revision", F.from_json("content", content)).alias("revisions"))
        _write_batch(flatten_comments(batch), out_dir + "/comments", batch_id)
        _write_batch(flatten_added_lines(batch), out_dir + "/added", batch_id)
        release(told)
        spark._jvm.System.gc()  # the shuffle files of batches that have ended go with the driver's garbage

    q1 = good.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint + "/good")
    bad = s.where(~usable).select("_corrupt", "id", "created")
    q2 = bad.writeStream.format("parquet").option("path", out_dir + "/bad") \
        .option("checkpointLocation", checkpoint + "/bad")
    if available_now:
        q1, q2 = q1.trigger(availableNow=True), q2.trigger(availableNow=True)
    # keyed state needs the RocksDB store; a query takes the setting when it starts
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        a = q1.start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return a, q2.start()


def review_stream(spark: SparkSession, lines_dir: str, lines_schema, out_dir: str, checkpoint: str, review_fn,
                  max_files_per_trigger: int | None = None, available_now: bool = True):
    """Row 104: submitted lines (Parquet files landing in ``lines_dir``) reviewed
    against a static comment base: ``review_fn(batch_df) -> DataFrame`` (for example
    ``plans.review.review`` with the model, reference and comments bound)."""
    r = spark.readStream.schema(lines_schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(lines_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(review_fn(batch), out_dir, batch_id)

    w = s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
