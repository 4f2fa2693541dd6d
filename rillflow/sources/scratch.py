"""Folders for written tables and files that are used again: shared by all executors, gone when the application ends."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset the context's checkpoint folder, or, in local runs only, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found


@functools.cache
def _own_dir() -> str:
    """A folder of this process, for local runs; it goes when the process ends."""
    made = tempfile.mkdtemp(prefix="rillflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def _place(spark: SparkSession) -> tuple[str, object, object]:
    """The application's folder, as text and as Hadoop path, and its file system."""
    folder = f"{shared_dir(spark).rstrip('/')}/rillflow-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return folder, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the application ends."""
    folder, path, files = _place(spark)
    files.deleteOnExit(path)
    return folder


def clean_up(spark: SparkSession) -> None:
    """Remove all that this application has written to its folder."""
    _, path, files = _place(spark)
    files.delete(path, True)
