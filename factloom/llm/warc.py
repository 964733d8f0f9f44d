"""WARC archives: revisit records for equal payloads, and reading back by boundary-chain verification.

Reading never trusts a magic string alone. Tasks over byte ranges emit, for every place that looks like a record, the place of
its successor (header length plus Content-Length). Pointer jumping from the start of each file - in round k a place knows its
2^k-th successor - keeps the reachable places only, in as many rounds as the logarithm of the longest chain. Records are then
read by offset. A header may have any length. A chain that does not end where its file ends, and a round trip that finds another
number of records than it wrote, are errors.

Defined results: a null or empty html has an empty payload; null urls are left out; a row with a null page_id revisits
the equal page with an id, if there is one; rows with the largest page_id of equal payloads are all responses; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, stash, text_of, unstash

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
HEADER_BYTES = 64 << 10  # read at first for a header; more is read until it ends
BROADCAST_ROWS = 100_000
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http + (payload if refers_to is None else b""))


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)}


def _header(f, data: bytes, at: int) -> tuple[bytes, int]:
    """(data, the place in it where the header at `at` ends, or -1). Data grows by what f reads on, until the header or the file ends."""
    head = data.find(END, at)
    while head < 0 and (more := f.read(max(HEADER_BYTES, len(data)))):
        data, since = data + more, max(at, len(data) - len(END) + 1)
        head = data.find(END, since)
    return data, head


def _length(data: bytes, at: int, head: int) -> tuple[int, str]:
    """(place, value) of the last Content-Length in the header from at to head; the place is -1 if there is none."""
    end = head
    while (start := data.rfind(b"\r\n", at, end)) >= 0:
        name, _, value = data[start + 2 : end].partition(b":")
        if name.strip().lower() == b"content-length":
            return start, value.strip().decode("utf-8", "replace")
        end = start
    return -1, ""


# ---- writing ----------------------------------------------------------------------------------------------------------------


def with_references(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to of pages (page_id, url, html). Payloads are compared by SHA-1 and length."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    equal = stash(groups.where("n > 1 and top is not null").select("digest", "size", "top"), "equal-payloads")
    few = equal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(equal) if few else equal.hint("merge"), ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes pages (page_id, url, payload, refers_to) as archives into folder; gives back the number of records.

    An archive gets its final name when it is complete; the name depends on the partition, so a task that runs again replaces it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        place, root = filesystem(folder)
        place.create_dir(root, recursive=True)
        number, written, stream, temporary = 0, 0, None, ""

        def close() -> None:
            nonlocal number, stream
            stream.close()
            place.move(temporary, f"{root}/part-{context.partitionId():06d}-{number:05d}.warc")
            number, stream = number + 1, None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stream is None:
                    temporary = f"{root}/_open-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}"
                    stream = place.open_output_stream(temporary)
                    stream.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{context.partitionId()}-{number}>"), ("WARC-Date", "1970-01-01T00:00:00Z")], b""))
                stream.write(page_record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to))
                written += 1
                if stream.tell() >= archive_bytes:
                    close()
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ---- reading ----------------------------------------------------------------------------------------------------------------


def archive_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(file, size, first, last: byte ranges over the archives of a folder; how many tasks they are dealt to). Only names and sizes pass the driver."""
    from pyarrow import fs

    place, root = filesystem(folder)
    files = [(f.path, f.size) for f in place.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".warc")]
    listed = spark.createDataFrame(sorted(files), "file string, size long")
    ranges = listed.where("size > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
    tasks = max(1, min(sum(-(-n // range_bytes) for _, n in files), 10_000))
    return ranges.withColumn("last", F.least(F.col("first") + range_bytes, "size")).repartition(tasks, "file", "first"), tasks


def candidates(ranges: DataFrame, folder: str) -> DataFrame:
    """file, at, next for every place that reads like a record, whether it is one or lies inside a payload."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, _ = filesystem(folder)
        for batch in batches:
            rows = []
            for file, size, first, last in batch[["file", "size", "first", "last"]].itertuples(index=False):
                with place.open_input_file(file) as f:
                    f.seek(first)
                    data = f.read(min(size, last + HEADER_BYTES) - first)
                    till = last - first + len(MAGIC) - 1
                    at, head = data.find(MAGIC, 0, till), -1
                    while at >= 0:
                        if head < at:  # else the places up to the same end share its last length
                            data, head = _header(f, data, at)
                            if head < 0:
                                break  # no header ends from here on
                            line, length = _length(data, at + len(MAGIC) - 2, head)
                        if line >= at + len(MAGIC) - 2 and length.isascii() and length.isdigit():
                            rows.append((file, first + at, first + head + 4 + int(length[:18]) + 4))
                        at = data.find(MAGIC, at + 1, till)
            yield pd.DataFrame(rows, columns=["file", "at", "next"])

    return ranges.mapInPandas(scan, "file string, at long, next long")


def reachable(links: DataFrame) -> DataFrame:
    """file, at of the places that the chain from place 0 of each file comes to. links: file, at, next.

    Both sides of each join have a row a record, so neither is ever broadcast.
    """
    known = stash(links.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("seen")), "chain")
    before = -1
    while True:
        seen = known.where("seen").count()
        if seen == before:
            return known.where("seen").select("file", "at")
        before = seen
        ahead = known.select("file", F.col("at").alias("jump"), F.col("jump").alias("beyond")).hint("merge")
        arrived = known.where("seen").select("file", F.col("jump").alias("at")).distinct().withColumn("arrived", F.lit(True)).hint("merge")
        moved = known.join(ahead, ["file", "jump"], "left").select("file", "at", F.coalesce("beyond", F.lit(-1).cast("long")).alias("jump"), "seen")
        step = stash(moved.join(arrived, ["file", "at"], "left").select("file", "at", "jump", (F.col("seen") | F.col("arrived").isNotNull()).alias("seen")), "chain")
        unstash(known)
        known = step


def read_records(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The page records at places (file, at), each read by its own offset, in `tasks` tasks: places alone are too small a table for Spark to tell how many."""

    def page(value: str | None) -> int | None:
        number = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = filesystem(folder)
        for batch in batches:
            rows = []
            for file, group in batch.to_pandas().groupby("file"):
                with place.open_input_file(file) as f:
                    for at in sorted(group["at"]):
                        f.seek(at)
                        data, head = _header(f, f.read(HEADER_BYTES), 0)
                        fields = _fields(data[len(MAGIC) : head])
                        kind, length = fields["warc-type"], int(fields["content-length"])
                        if kind not in ("response", "revisit"):
                            continue
                        block = data[head + 4 : head + 4 + length]
                        if len(block) < length:
                            block += f.read(length - len(block))
                        body = block.index(b"\r\n\r\n") + 4
                        size = int(_fields(block[:body])["content-length"])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (len(block) - body != size or hashlib.sha1(memoryview(block)[body:]).hexdigest() != digest):
                            raise ValueError(f"{file}@{at}: the payload does not match its digest")
                        rows.append({"page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("warc-refers-to"))})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    together = places.repartition(tasks, "file", F.floor(F.col("at") / RANGE_BYTES))  # neighbours in a file are read by one task
    return together.mapInArrow(read, RECORDS)


def record_places(ranges: DataFrame, folder: str) -> DataFrame:
    """file, at of all records, of archives whose chains end where the files end."""
    links = stash(candidates(ranges, folder), "links")
    places = reachable(links)
    ends = links.join(places.groupBy("file").agg(F.max("at").alias("at")).hint("merge"), ["file", "at"]).select("file", F.col("next").alias("end"))
    broken = ranges.select("file", "size").distinct().join(ends, "file", "left").where("end IS NULL OR end <> size").first()
    if broken:
        raise ValueError(f"{broken['file']}: the chain of records ends at {broken['end']}, the file at {broken['size']}")
    unstash(links)
    return places


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    ranges, tasks = archive_ranges(spark, folder, range_bytes)
    return read_records(record_places(ranges, folder), folder, tasks)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_path(pages.sparkSession, "warc")
    written = write_warc(with_references(pages), folder)
    ranges, tasks = archive_ranges(pages.sparkSession, folder)
    places = record_places(ranges, folder)
    found = places.where("at > 0").count()  # at 0 is the archive's own record
    if found != written:
        raise ValueError(f"{folder}: {written} records were written, {found} are found")
    return read_records(places, folder, tasks)
