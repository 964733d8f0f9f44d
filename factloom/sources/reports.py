"""Readers of report files. A file is decoded once: what comes of it is written, and items, documents and errors are read from there."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.operators.history import find_by_files
from factloom.sources.folders import arrow_files, new_folder

ITEMS = "document_id string, page_number int, item_ord int, str string, x double, y double, width double, height double"
DECODED = f"{ITEMS}, filename string, file_size long, error string"
TASK_BYTES = 64 << 20
TASK_FILES = 1000
Decoder = Callable[[bytes], Iterator[tuple[int, int, str, float, float, float, float]]]
_FIELDS = [("document_id", pa.string()), ("page_number", pa.int32()), ("item_ord", pa.int32()), ("str", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "width", "height")], ("filename", pa.string()), ("file_size", pa.int64()), ("error", pa.string())]
_ROWS = 20_000


def is_pdf(name: Column, mime: Column | None = None) -> Column:
    by_name = F.lower(name).endswith(".pdf")
    return by_name if mime is None else by_name | (mime == "application/pdf")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files  # (path, bytes)


def dealt(files: list[tuple[str, int]], task_bytes: int, task_files: int = TASK_FILES) -> list[list[tuple[str, int]]]:
    """Files in partitions of about task_bytes, each of at most task_files; a larger file is one of its own."""
    out: list[list[tuple[str, int]]] = []
    size = 0
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        if not out or size + n > task_bytes or len(out[-1]) == task_files:
            out.append([])
            size = 0
        out[-1].append((path, n))
        size += n
    return out


class _ReportReader(DataSourceReader):
    def __init__(self, options: dict, decoder: Decoder | None):
        self.path, self.decoder = options["path"], decoder
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.listing = options.get("list", "false") == "true"
        self.skip = options.get("skip")

    def _found(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        files, root = arrow_files(self.path)
        return [(f.path, f.size) for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.lower().endswith(".pdf")]

    def _known(self) -> set[tuple[str, int]]:
        """Names and sizes that are left out: a folder of JSON lines, as large as the listing at most."""
        if not self.skip:
            return set()
        from pyarrow import fs

        files, root = arrow_files(self.skip)
        known = set()
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and f.base_name.endswith(".json"):
                with files.open_input_stream(f.path) as source:
                    known |= {(x["filename"], x["file_size"]) for x in map(json.loads, source.read().decode().splitlines())}
        return known

    def partitions(self) -> list[InputPartition]:
        known = self._known()
        return [_Files(own) for own in dealt([f for f in self._found() if (f[0].rpartition("/")[2], f[1]) not in known], self.task_bytes)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, _ = arrow_files(self.path)
        rows: list[tuple] = []
        for path, size in partition.files:
            name = path.rpartition("/")[2]
            if self.listing:
                own = [(path, None, None, None, None, None, None, None, name, size, None)]
            else:
                try:
                    with files.open_input_stream(path) as source:
                        own = [(path, *item, name, size, None) for item in self.decoder(source.read())]
                    own = own or [(path, None, None, None, None, None, None, None, name, size, None)]
                except Exception as error:  # whatever a decoder raises belongs to its file
                    own = [(path, None, None, None, None, None, None, None, name, size, f"{type(error).__name__}: {error}")]
            for at in range(0, len(own), _ROWS):
                rows += own[at : at + _ROWS]
                if len(rows) >= _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def report_source(decoder: Decoder | None = None) -> type[DataSource]:
    """A data source "report_files" over the PDF files below a folder, with a decoder that the caller brings.

    decoder(content) yields (page, item, str, x, y, width, height). Options: path; taskbytes, the bytes of files that a task decodes;
    skip, a folder of JSON lines (filename, file_size) of files that are left out; list, "true" to name files without opening them.
    Rows are those of DECODED: a file's items, or one row with its error, or one without an item if there is none.
    """

    class ReportFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "report_files"

        def schema(self) -> str:
            return DECODED

        def reader(self, schema) -> DataSourceReader:
            return _ReportReader(self.options, decoder)

    return ReportFiles


def report_files(spark: SparkSession, path: str, decoder: Decoder | None = None, skip: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of the data source; without a decoder, one row a file that wasn't opened."""
    spark.dataSource.register(report_source(decoder))
    reader = spark.read.format("report_files").option("taskbytes", str(task_bytes)).option("list", str(decoder is None).lower())
    return (reader.option("skip", skip) if skip else reader).load(path)


def ingested(spark: SparkSession, path: str, decoder: Decoder, history: DataFrame, out: str | None = None, task_bytes: int = TASK_BYTES) -> dict[str, DataFrame]:
    """The PDF files below a folder: items and documents of new files, errors of those that can't be decoded, and skipped ones with the run that read them.

    A file is known by its name and size. New files are decoded one by one, so that a bad one costs no other, and once: their rows are
    written to out (by default a new shared folder), by whether they are errors, and everything returned is read from there.
    """
    listed = report_files(spark, path, task_bytes=1 << 62).select(F.col("document_id"), "filename", "file_size")
    known = find_by_files(history, listed.select(F.col("filename").alias("name"), F.col("file_size").alias("size"))).where("run_id is not null")
    folder = out or new_folder(spark, "decoded")
    skipped = listed.join(known, (F.col("filename") == F.col("name")) & (F.col("file_size") == F.col("size"))).select("document_id", "filename", "file_size", "run_id")
    skipped.write.mode("overwrite").json(f"{folder}/skipped")
    rows = report_files(spark, path, decoder, f"{folder}/skipped", task_bytes)
    rows.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(f"{folder}/rows")
    return read_ingested(spark, folder)


def read_ingested(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What ingested() wrote to a folder: items, documents, errors, skipped."""
    rows = spark.read.schema(f"{DECODED}, failed boolean").parquet(f"{folder}/rows")
    good = rows.where("not failed")
    items = good.where("item_ord is not null").select("document_id", "page_number", "item_ord", "str", "x", "y", "width", "height")
    documents = good.groupBy("document_id", "filename", "file_size").agg(F.max("page_number").alias("page_count")).where("page_count is not null")
    documents = documents.withColumn("doc_ord", F.xxhash64("document_id").bitwiseAND(F.lit((1 << 39) - 1)))
    skipped = spark.read.schema("document_id string, filename string, file_size long, run_id string").json(f"{folder}/skipped")
    return {"items": items, "documents": documents, "errors": rows.where("failed").select("document_id", "error"), "skipped": skipped}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path)
