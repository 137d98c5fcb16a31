"""Session construction and lineage helpers.

The library never creates a session inside an operator; callers pass one in.
``build_session`` is for tests, the bench and local runs. On a cluster the
session comes from the platform and only the scratch helpers are used.
"""

from __future__ import annotations

import os
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the driver keeps the text of every plan it has run, pages of it for wide tables
    "spark.sql.ui.retainedExecutions": "20",
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.maxPlanStringLength": "100000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it to a shared file system. Only when it is
    unset (local tests) do we create one, and only for a local master.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


_WRITTEN = threading.local()


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, for several readers.
    Inside :func:`temporary` only with ``keep`` for longer than that."""
    spark = df.sparkSession
    path = scratch_path(spark, f"riskloom/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not keep and getattr(_WRITTEN, "paths", None) is not None:
        _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`materialize` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that have ended: it does so when the
    JVM collects what refers to them, which with much memory may be long after. A first
    collection leaves what Spark still holds of the last query; the second takes it."""
    spark._jvm.System.gc()
    time.sleep(1)
    spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes by :func:`materialize` without ``keep`` are deleted at
    the end, and the shuffle files of what has ended are released."""
    before, _WRITTEN.paths = getattr(_WRITTEN, "paths", None), []
    try:
        yield
    finally:
        written, _WRITTEN.paths = _WRITTEN.paths, before
        for path in written:
            delete_table(spark, path)
        release_shuffles(spark)
