import hashlib

import pytest

from factloom.llm import warc

FAKE = warc.page_record(999, "http://fake", b"inner", hashlib.sha1(b"inner").digest(), None).decode()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, at int")


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == payload and p is not None), default=None)
        revisit = len(payload) >= 1000 and top is not None and (page_id is None or page_id < top)
        out.append((page_id if page_id is not None else -1, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else -1))
    return sorted(out)


ROWS = [
    (1, "http://a", "x" * 1000), (2, "http://a", "x" * 1000), (7, None, "x" * 1000), (3, "u", "y" * 999), (4, "u", "y" * 999), (5, "u\r\nv", None), (6, "u", ""),
    (8, "é", FAKE * 40), (9, "é", "é" * 500), (10, "z", "é" * 500), (None, "n", "x" * 1000), (11, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "q" * 5000), (11, "u", "same"), (11, "u", "same"),
    *[(100 + n, "u", f"page {n} " * (n % 50)) for n in range(300)],
]


@pytest.mark.parametrize("range_bytes", [700, 1 << 22])
def test_round_trip_equals_brute_force(spark, tmp_path, range_bytes):
    folder = f"file://{tmp_path}/w"
    table = pages(spark, ROWS)
    assert warc.write_warc(warc.with_references(table), folder, archive_bytes=200_000) == len(ROWS)
    rows = warc.read_warc(spark, folder, range_bytes).collect()
    minus = lambda x: -1 if x is None else x
    assert sorted((minus(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, minus(r.refers_to)) for r in rows) == brute(ROWS)


def test_magic_inside_payloads_is_found_and_rejected(spark, tmp_path):
    folder = f"file://{tmp_path}/f"
    warc.write_warc(warc.with_references(pages(spark, ROWS)), folder)
    links = warc.candidates(warc.archive_ranges(spark, folder)[0], folder)
    files = links.select("file").distinct().count()
    assert links.count() == len(ROWS) + files + 41 and warc.reachable(links).count() == len(ROWS) + files


def test_many_equal_payloads_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(n, "u", "k" * 2000) for n in range(200)]
    got = warc.with_references(pages(spark, rows)).collect()
    assert sorted((r.page_id, r.refers_to or -1) for r in got) == [(n, 199 if n < 199 else -1) for n in range(200)]


def test_empty_table(spark):
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


LONG = [(1, "http://" + "a" * 70_000, "one"), (2, "b " * 200_000, "two" * 500), (3, "http://x/WARC/1.1", "three"), (4, "u", "WARC/1.1\r\n" * 9000), (5, "c" * 65_536, "two" * 500), (6, "u", "x")]


@pytest.mark.parametrize("range_bytes", [5000, 1 << 22])
def test_headers_of_any_length(spark, tmp_path, range_bytes):
    folder = f"file://{tmp_path}/l"
    assert warc.write_warc(warc.with_references(pages(spark, LONG).coalesce(1)), folder) == len(LONG)
    minus = lambda x: -1 if x is None else x
    rows = warc.read_warc(spark, folder, range_bytes).collect()
    assert sorted((minus(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, minus(r.refers_to)) for r in rows) == brute(LONG)
    assert warc.warc_round_trip(pages(spark, LONG).coalesce(1)).count() == len(LONG)


def test_a_broken_chain_and_missing_records_are_errors(spark, tmp_path, monkeypatch):
    folder = tmp_path / "b"
    warc.write_warc(warc.with_references(pages(spark, ROWS).coalesce(1)), f"file://{folder}")
    (file,) = folder.glob("*.warc")
    whole = file.read_bytes()
    at = whole.index(b"Content-Length", len(whole) // 2)
    for cut in (whole[:-1], whole[:at] + b"Kontent-Length" + whole[at + 14 :], b"x" + whole):
        file.write_bytes(cut)
        with pytest.raises(ValueError, match="chain of records ends"):
            warc.read_warc(spark, f"file://{folder}")
    write = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda *a: write(*a) + 1)
    with pytest.raises(ValueError, match="are found"):
        warc.warc_round_trip(pages(spark, ROWS))
