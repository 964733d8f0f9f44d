import hashlib
import zlib
from pathlib import Path

import pytest

from factloom.llm.media import MediaReader, decode_png, encode_png, media_report, padded, read_archives, write_archives

TEXTS = [None, "", "x", "y" * 192, "z" * 193, "é😀" * 5000, "same", "same", "long " * 60_000]


def test_round_trip(docs):
    rows = {r.doc_id: r for r in media_report(docs(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192) or b" " * 192
        r = rows[n]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert decode_png(encode_png(payload)) == payload == padded(data) and hashlib.sha256(encode_png(payload)).hexdigest() == r.media_sha256
    assert rows[6][1:] == rows[7][1:]


def test_every_range_size_reads_each_member_once(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    assert write_archives(docs(TEXTS), folder, archive_bytes=3000) == len(TEXTS)
    for size in (1000, 7777, 1 << 30):
        assert sorted(r.id for r in read_archives(spark, folder, size).collect()) == list(range(len(TEXTS)))


def test_a_broken_member_leaves_the_others(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    write_archives(docs([f"text {n}" * 50 for n in range(20)]).coalesce(1), folder)
    path = next(Path(tmp_path, "b").glob("*.zip"))
    data = bytearray(path.read_bytes())
    data[data.index(b"IDAT") + 6] ^= 255
    path.write_bytes(data)
    rows = read_archives(spark, folder).collect()
    assert len(rows) == 20 and [r.id for r in rows if r.error] == [0] and all(r.payload for r in rows if not r.error)


def test_a_member_is_retried_by_offset(docs, tmp_path):
    folder = f"file://{tmp_path}/c"
    write_archives(docs(["a", "b"]).coalesce(1), folder)
    reader = MediaReader(folder, attempts=3)
    seen = []

    class Flaky:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            seen.append(path)
            if len(seen) % 2:
                raise OSError("lost")
            return self.inner.open_input_file(path)

    import zipfile

    from pyarrow import fs

    path = str(next(Path(tmp_path, "c").glob("*.zip")))
    for info in zipfile.ZipFile(path).infolist():
        assert decode_png(reader.member(Flaky(fs.LocalFileSystem()), path, info))
    assert len(seen) == 4


def test_empty_table_and_null_ids(docs):
    assert media_report(docs([])).count() == 0
    assert sorted(r.doc_id or -1 for r in media_report(docs(["a", "a"], [None, 4])).collect()) == [-1, 4]


def test_other_images_are_refused():
    with pytest.raises(ValueError):
        decode_png(b"no image")
