"""The assembled document on storage: parts that joined in the order of their names are one valid JSON text.

Objects (kind, ref, json) are dealt to tasks by ranges of their place - the schema, the contexts and units in the order in which facts
first name them, the facts by fact_ord - so no task sees the whole and no order is lost. A task writes its objects with commas between
them; what opens, closes and parts the sections between two tasks is known only at the end, and the job's commit adds it as small parts
of its own. What a task that failed has left is deleted by then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from factloom.sources.folders import arrow_files

#: Sections in their order: (kind, what opens it, what closes it).
SECTIONS = [("context", '"contexts":{', "}"), ("unit", '"units":{', "}"), ("fact", '"facts":[', "]")]
_PLACE = {kind: n for n, (kind, _, _) in enumerate(SECTIONS)}


def between(before: int, after: int) -> str:
    """The text between an object of one section and one of another. -1: the beginning, behind the schema; len(SECTIONS): the end."""
    if before == after:
        return ","
    text = SECTIONS[before][2] if before >= 0 else ""
    for n in range(before + 1, after):
        text += "," + SECTIONS[n][1] + SECTIONS[n][2]
    return text + ("," + SECTIONS[after][1] if after < len(SECTIONS) else "}")


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str
    first: int  # section of the first object, -1 without one
    last: int
    objects: int


class _DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.schema_name = options["path"], options.get("schemaname", "factloom-xbrl-like/v1")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = arrow_files(self.path)
        part = TaskContext.get().partitionId()
        name, first, last, objects = f"_{part:08d}-{uuid.uuid4().hex}", -1, -1, 0
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                rows = batch.to_pydict()
                pieces = []
                for kind, ref, body in zip(rows["kind"], rows["ref"], rows["json"], strict=True):
                    here = _PLACE[kind]
                    pieces += ([between(last, here)] if objects else []) + ([json.dumps(ref, ensure_ascii=False), ":"] if kind != "fact" else []) + [body]
                    first, last, objects = (here if not objects else first), here, objects + 1
                out.write("".join(pieces).encode())
        return _Written(part, name, first, last, objects)

    def commit(self, messages: list[_Written | None]) -> None:
        """Names the parts in their order, with what goes between them; the document is whole once the last part, the end, is there."""
        files, root = arrow_files(self.path)
        told = sorted((m for m in messages if m), key=lambda m: m.part)
        for m in told:
            if not m.objects:
                files.delete_file(f"{root}/{m.file}")
        from pyarrow import fs

        named = {m.file for m in told}
        for left in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if left.base_name[:2] == "_0" and left.base_name not in named:  # of a task that was tried again
                files.delete_file(left.path)
        some = [m for m in told if m.objects]
        before = -1
        head = '{"schema":' + json.dumps(self.schema_name)
        for n, m in enumerate(some):
            self._glue(files, f"{root}/part-{n:08d}-a", (head if n == 0 else "") + between(before, m.first))
            files.move(f"{root}/{m.file}", f"{root}/part-{n:08d}-b")
            before = m.last
        self._glue(files, f"{root}/part-{len(some):08d}-c", ("" if some else head) + between(before, len(SECTIONS)))

    def _glue(self, files, path: str, text: str) -> None:
        with files.open_output_stream(path) as out:
            out.write(text.encode())

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = arrow_files(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.file}")


class DocumentParts(DataSource):
    """Data source "document_parts": writes rows (kind, ref, json) that come in the order of the document. Options: path, schemaname."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return "kind string, ref string, json string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options)


def in_document_order(objects: DataFrame, tasks: int) -> DataFrame:
    """kind, ref, json dealt to tasks by ranges of (section, place). objects: kind, ref, json, place."""
    section: Column = F.lit(len(SECTIONS))
    for kind, n in _PLACE.items():
        section = F.when(F.col("kind") == kind, n).otherwise(section)
    placed = objects.where(F.col("kind").isin(*_PLACE)).withColumn("section", section)
    return placed.repartitionByRange(tasks, "section", "place", "ref").sortWithinPartitions("section", "place", "ref").select("kind", "ref", "json")


def write_document(objects: DataFrame, path: str, tasks: int = 32, schema_name: str = "factloom-xbrl-like/v1") -> None:
    """Writes facts.document_objects() to a folder that is empty or not there; another one is an error."""
    from pyarrow import fs

    spark = objects.sparkSession
    files, root = arrow_files(path)
    if files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{path} holds something already")
    spark.dataSource.register(DocumentParts)
    in_document_order(objects, tasks).write.format("document_parts").option("schemaname", schema_name).mode("append").save(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """name, text of the parts of a document, in no order; their texts in the order of the names are the document."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))
