"""Media columns: payloads kept as lossless images in archives, read through a Spark data source of our own.

Writing: each task rolls ZIP archives (members stored, not packed again) of one 8-bit grey PNG a payload into a folder; an
archive gets its final name, which depends on the partition and its number there, only when it is complete, so a task that
runs again replaces what its lost attempt left. Reading: the plan is byte ranges over the archives - sizes only, no member list
passes the driver. A task reads the archive's central directory, takes the members whose local header starts in its range, and
streams them as Arrow batches. Each member is read again by its own offset when it fails; what fails for good comes back as a
row with `error`, and its neighbours stay.

Defined results: a null or empty text is one row of 192 spaces (n_bytes 0); a null id is carried along; repeated rows give
repeated rows with equal values; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, fresh_path, text_of

UNIT = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
FIELDS = "id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- one member -------------------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % UNIT or (0 if data else UNIT))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image of UNIT samples a row, without filters; equal payloads give equal bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[0] != UNIT or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this kind")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("rows with filters")
    return lines[:, 1:].tobytes()


# ---- writing ----------------------------------------------------------------------------------------------------------------


def write_archives(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes every row's payload into archives in folder; gives back how many there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        place, root = filesystem(folder)
        place.create_dir(root, recursive=True)
        number, members, total, stream, archive, temporary = 0, 0, 0, None, None, ""

        def close() -> None:
            nonlocal number, stream
            archive.close()
            stream.close()
            place.move(temporary, f"{root}/part-{context.partitionId():06d}-{number:05d}.zip")
            number, stream = number + 1, None

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if stream is None:
                    temporary = f"{root}/_open-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}"
                    stream = place.open_output_stream(temporary)
                    archive = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED)
                data = text.as_buffer().to_pybytes()
                image = encode_png(padded(data))
                archive.writestr(zipfile.ZipInfo(f"{'null' if key is None else key}.{len(data)}.png"), image)
                members, total = members + 1, total + len(image)
                if stream.tell() >= archive_bytes:
                    close()
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict({"members": [members], "bytes": [total]}, schema=pa.schema([("members", pa.int64()), ("bytes", pa.int64())]))

    rows = documents.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("data"))
    made = rows.mapInArrow(write, "members long, bytes long")
    return made.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]


class _Forward(io.RawIOBase):
    """A stream that only goes forward; ZipFile then needs no seeking."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def tell(self) -> int:
        raise OSError("forward only")


# ---- reading ----------------------------------------------------------------------------------------------------------------


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder): a row a member, whatever archive it lies in."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int = RANGE_BYTES, attempts: int = ATTEMPTS):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        place, root = filesystem(self.folder)
        files = place.get_file_info(fs.FileSelector(root, allow_not_found=True))
        whole = sorted((f.path, f.size) for f in files if f.base_name.endswith(".zip"))
        return [ByteRange(p, a, a + self.range_bytes) for p, n in whole for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, place, path: str, info: zipfile.ZipInfo) -> bytes:
        """The stored bytes of one member, by its own offset; each attempt opens the archive anew."""
        for attempt in range(self.attempts):
            try:
                with place.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member at this offset")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(info.header_offset + 30 + name + extra)
                    data = f.read(info.file_size)
                if zlib.crc32(data) != info.CRC:
                    raise ValueError("bad checksum of a member")
                return data
            except (OSError, ValueError, struct.error):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise ValueError("no attempt")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        place, _ = filesystem(self.folder)
        with place.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            own = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        for info in own:
            key, n_bytes, _ = info.filename.split(".")
            row = {"id": None if key == "null" else int(key), "n_bytes": int(n_bytes), "payload": None, "media_bytes": info.file_size, "media_sha256": None, "error": None}
            try:
                image = self.member(place, partition.path, info)
                row["media_sha256"] = hashlib.sha256(image).hexdigest()
                row["payload"] = decode_png(image)
            except (OSError, ValueError, struct.error, zlib.error) as error:
                row["error"] = f"{partition.path}@{info.header_offset}: {error}"
            rows.append(row)
            held += len(row["payload"] or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"id": pa.int64(), "n_bytes": pa.int64(), "payload": pa.binary(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "error": pa.string()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(types.items())))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).load(folder)


# ---- features ---------------------------------------------------------------------------------------------------------------


def feature_of(payload: bytes) -> str:
    """Whole-number statistics of the samples: mean and spread in thousandths, edges in 1000 steps, histogram of 8 in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    n, total = len(samples), int(samples.sum(dtype=np.uint64))
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    square = int((counts * values * values).sum())
    spread = int((max(0, n * square - total * total) ** 0.5) * 1000 / n)
    edges = int(np.count_nonzero(samples[1:] != samples[:-1]) * 1000 // n)
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{total * 1000 // n}:{spread}:{edges}:" + "-".join(map(str, bins.tolist()))


def media_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores the payloads, reads them back, and gives digests and features of what was read."""
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "media")
    write_archives(documents, folder, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [b.as_buffer() if b.is_valid else b"" for b in batch.column("payload")]
            if errors := [e for e in batch.column("error").to_pylist() if e]:
                raise OSError("; ".join(errors[:5]))
            columns = [
                batch.column("id"), batch.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(memoryview(p)[-16:]) for p in payloads], pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array([feature_of(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = read_archives(spark, folder)
    made = read.mapInArrow(digest, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return made.withColumnRenamed("id", id_col)
