"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every flowlens job assumes.

    Only result-relevant settings (UTC, Arrow) and adaptive execution are fixed here; partition
    counts and memory belong to the cluster and are passed through ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local folder is made, and removed when the program ends; on a cluster that
    is an error, since executors do not see each other's folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="flowlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def store(
    df: DataFrame, name: str, *partition_by: str, session: SparkSession | None = None
) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later stages scan the columns they need from there, and a lost executor does not recompute
    what led to it. It is read by ``session``, by default the frame's own.
    """
    spark = session or df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` rows for what is run meanwhile.

    Rows of whole texts are long, and both sides of a Python step hold two batches.
    """
    before = int(spark.conf.get(_ARROW_ROWS))
    spark.conf.set(_ARROW_ROWS, str(most if before <= 0 else min(before, most)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, str(before))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it from the file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_by_value(module: str) -> None:
    """Send a module's functions to the workers inside the task, so no package install is needed.

    This module goes with them, since a module that is sent whole carries this function.
    """
    for name in (module, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])
