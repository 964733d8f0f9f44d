"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20
LEAST_FILES, ROWS_A_FILE = 8, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark only (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: set[str] = set()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def clear_working_tables(spark: SparkSession) -> None:
    """Deletes whatever working tables and archives this driver has written and not deleted yet. Results that were not written anywhere can't be read any more."""
    for path in sorted(_WRITTEN):
        delete_path(spark, path)


def stash(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back. rows: about how many, if known, so that few rows make few files."""
    path = fresh_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows // ROWS_A_FILE))
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def unstash(*stashed: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing reads it any more."""
    for df in stashed:
        path = getattr(df, "_stash_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _WRITTEN.discard(path)


def numbered(documents: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """documents with their columns called c0, c1 and so on, so that none clashes with a name inside an operator, and what `names` are called there.

    The operator's last step is ``toDF(*documents.columns)``.
    """
    return documents.toDF(*[f"c{k}" for k in range(len(documents.columns))]), [f"c{documents.columns.index(n)}" for n in names]


def text_of(column: str | Column) -> Column:
    """A text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def sha256_of(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder that tasks write and read by themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker keeps from task to task, such as tokenizers with the words they have seen.
KEPT: dict[str, object] = {}


def freed(task: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A mapInArrow or mapInPandas function that hands memory back to the system once its last batch is out.

    Python workers outlive their tasks, and what numpy and Arrow keep for later would add up over the stages of a job. A task that
    doesn't itself use what other operators' tasks have kept drops it first.
    """

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        if KEPT and not keeps:
            KEPT.clear()
            _hand_back()
        yield from task(batches)
        _hand_back()

    return run


def _hand_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def in_arrow(rows: DataFrame, task: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """rows.mapInArrow(task, schema) in batches of about BATCH_BYTES (a longer row is a batch of its own), for whatever reads rows of texts.

    By default a batch holds up to 64 MB of texts, several times over: in the executor, in its Arrow copy and in the Python worker.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(freed(task), schema)
