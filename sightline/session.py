"""Spark session helpers.

The library never creates its own session inside an operator; callers pass one.
``get_spark`` is a convenience for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "sightline",
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset (local
    tests) a scratch folder is created; on a cluster the setting must name a shared
    file system path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="sightline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """What is written within leaves no shuffle files: they are deleted when the job has ended, not when the driver
    happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def cut_lineage(df):
    """Cut lineage with a written table in the shared checkpoint folder (never a
    machine-local one): one job writes Parquet, later steps read it back.  (A
    reliable ``checkpoint()`` would compute the plan twice: once to count, once to
    write.)"""
    import uuid
    spark = df.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + "/sightline-tables/" + uuid.uuid4().hex
    with shuffles_go(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def release(*tables) -> None:
    """Delete the files of tables that ``cut_lineage`` wrote, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
