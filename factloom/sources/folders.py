"""Folders that the driver and all executors share, and what the driver does with files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode (tests), and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder in the shared one that isn't there yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """(Hadoop's file system, Hadoop's path), for the driver."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    files, found = hadoop(spark, path)
    files.delete(found, True)


def arrow_files(uri: str):
    """(Arrow's file system, path in it), for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
