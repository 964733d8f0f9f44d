"""Report files, the assembled document and the history on storage."""

import json
import os
import random
import threading

import pytest

from factloom.operators import facts as X
from factloom.operators import history
from factloom.sources import documents, reports
from factloom.sources import history as store

FACTS = "document_id string, filename string, scope string, statement_type string, concept string, label string, period string, value double, unit string, page_number int, confidence double, raw_line string, all_values array<string>, period_labels array<string>, column_labels array<string>, notes array<string>, evidence map<string,string>, extraction_order int, fact_ord long"


def no_runs(spark):
    return history.normal_runs(spark.createDataFrame([], "id string, files array<struct<name:string,size:long>>"))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "log").mkdir()
    for name, content in (("A.PDF", b"3"), ("b.pdf", b"bad"), ("c.txt", b"1"), ("deep/d.pdf", b"2"), ("none.pdf", b"0"), ("half.pdf", b"-2")):
        (tmp_path / "in" / name).write_bytes(content)
    log = f"{tmp_path}/log"

    def decoder(content):
        open(f"{log}/{content.decode()}-{random.getrandbits(60)}", "w").close()
        n = int(content)
        for page in range(1, abs(n) + 1):
            yield page, 0, f"item {page}", 1.0, 2.0, 3.0, 4.0
            if n < 0:
                raise EOFError("cut off")

    return f"file://{tmp_path}/in", log, decoder


def test_each_file_is_decoded_once_whatever_is_read_of_it(spark, folder):
    path, log, decoder = folder
    read = reports.ingested(spark, path, decoder, no_runs(spark))
    for _ in range(2):
        assert sorted((r["document_id"].rpartition("/")[2], r["page_number"], r["str"]) for r in read["items"].collect()) == [("A.PDF", 1, "item 1"), ("A.PDF", 2, "item 2"), ("A.PDF", 3, "item 3"), ("d.pdf", 1, "item 1"), ("d.pdf", 2, "item 2")]
        assert sorted((r["filename"], r["file_size"], r["page_count"]) for r in read["documents"].collect()) == [("A.PDF", 1, 3), ("d.pdf", 1, 2)]
        assert sorted((r["document_id"].rpartition("/")[2], r["error"].partition(":")[0]) for r in read["errors"].collect()) == [("b.pdf", "ValueError"), ("half.pdf", "EOFError")]
    assert sorted(n.rpartition("-")[0] for n in os.listdir(log)) == ["-2", "0", "2", "3", "bad"]


def test_known_files_are_skipped_and_not_opened(spark, folder):
    path, log, decoder = folder
    known = history.normal_runs(spark.createDataFrame([("r1", [("A.PDF", 1), ("d.pdf", 77)])], "id string, files array<struct<name:string,size:long>>"))
    read = reports.ingested(spark, path, decoder, known)
    assert [(r["filename"], r["run_id"]) for r in read["skipped"].collect()] == [("A.PDF", "r1")]
    assert [r["filename"] for r in read["documents"].collect()] == ["d.pdf"]
    assert "3" not in {n.rpartition("-")[0] for n in os.listdir(log)}


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    read = reports.ingested(spark, f"file://{tmp_path}/empty", lambda content: iter(()), no_runs(spark))
    assert [df.count() for df in read.values()] == [0, 0, 0, 0]


def test_files_are_dealt_by_their_bytes():
    files = [(f"f{k}", n) for k, n in enumerate([5, 100, 1, 1, 1, 40, 30, 0])]
    parts = reports.dealt(files, 50)
    assert sorted(f for p in parts for f in p) == sorted(files) and all(len(p) == 1 or sum(n for _, n in p) <= 50 for p in parts)
    assert [len(p) for p in reports.dealt([("a", 1)] * 5, 50, 2)] == [2, 2, 1] and reports.dealt([], 50) == []


def some_facts(spark, n):
    rows = [("d", 'a"b.pdf', "separate", "balance_sheet", f"C{k % 5}", f"계정 {k}", ["2024.12.31", "제57기", "", "FY 2023"][k % 4], k / 4, ["KRW", "", "krw", "천원"][k % 4], 1, 0.5, "line", ["1", None], [], ["당기"], [], {"page": "1"}, k, 7 * k) for k in range(n)]
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize(("n", "tasks"), [(0, 3), (1, 4), (60, 1), (60, 7), (60, 200)])
def test_parts_joined_are_one_valid_document(spark, tmp_path, n, tasks):
    path = f"file://{tmp_path}/document"
    facts = some_facts(spark, n).repartition(3)
    documents.write_document(X.document_objects(facts), path, tasks)
    parts = sorted((r["name"], r["text"]) for r in documents.read_parts(spark, path).collect())
    whole = json.loads("".join(text for _, text in parts))
    assert list(whole) == ["schema", "contexts", "units", "facts"] and len(whole["facts"]) == n
    objects = {(r["kind"], r["ref"]): json.loads(r["json"]) for r in X.document_json(facts).collect()}
    assert whole["contexts"] == {ref: o for (kind, ref), o in objects.items() if kind == "context"}
    assert whole["units"] == {ref: o for (kind, ref), o in objects.items() if kind == "unit"}
    assert whole["facts"] == [o for _, o in sorted((int(ref), o) for (kind, ref), o in objects.items() if kind == "fact")]
    if n > 3:
        assert list(whole["contexts"]) == ["separate_2024_12_31", "separate_제57기", "separate_unknown", "separate_FY_2023"] and list(whole["units"]) == ["KRW", "천원"]
    if n:
        assert not [f for f in os.listdir(f"{tmp_path}/document") if f.startswith("_") and not f.startswith("_SUCCESS")]
        with pytest.raises(FileExistsError):
            documents.write_document(X.document_objects(facts), path, tasks)


def runs_of(spark, *rows):
    return spark.createDataFrame(rows, "id string, seq long")


def payload(spark, run_id, n):
    return history.payload_of(run_id, facts=spark.range(n).withColumnRenamed("id", "fact_ord"))


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failures = f"file://{tmp_path}/history", []

    def write(writer):
        try:
            for k in range(4):
                store.save(spark, path, runs_of(spark, (f"{writer}{k}", k)), payload=payload(spark, f"{writer}{k}", k + 1))
        except Exception as error:  # seen by the test, not by the thread
            failures.append(error)

    threads = [threading.Thread(target=write, args=(w,)) for w in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    assert sorted(r["id"] for r in store.load(spark, path).collect()) == sorted(f"{w}{k}" for w in "xyz" for k in range(4))
    assert len(store.versions(spark, path)) <= store.KEPT_VERSIONS + 3 and store.versions(spark, path)[-1] == 11
    for w in "xyz":
        assert [store.found_by(spark, path, f"{w}{k}", "facts", "fact_ord long").count() for k in range(4)] == [1, 2, 3, 4]


def test_payload_is_appended_and_unused_parts_go(spark, tmp_path):
    path, parts = f"file://{tmp_path}/history", f"{tmp_path}/history/payload"
    store.save(spark, path, runs_of(spark, ("a", 1), ("b", 1)), payload=payload(spark, "a", 2).unionByName(payload(spark, "b", 3)))
    first = set(os.listdir(parts))
    times = {p: os.stat(f"{parts}/{p}").st_mtime_ns for p in first}
    store.save(spark, path, runs_of(spark, ("c", 2)), payload=payload(spark, "c", 1))
    assert {p: os.stat(f"{parts}/{p}").st_mtime_ns for p in first} == times and len(os.listdir(parts)) == 2
    store.save(spark, path, runs_of(spark, ("a", 3)), payload=payload(spark, "a", 5))
    store.save(spark, path, runs_of(spark, ("b", 4)))  # without a payload: the old one stays
    assert [store.found_by(spark, path, r, "facts", "fact_ord long").count() for r in "abc"] == [5, 3, 1]
    store.delete(spark, path, spark.createDataFrame([("b",), ("c",)], "id string"))
    assert store.vacuum(spark, path, kept=1) == []  # too young
    gone = store.vacuum(spark, path, kept=1, unused=0.0)
    assert len([g for g in gone if g.startswith("payload/")]) == 2 and len(os.listdir(parts)) == 1
    assert store.found_by(spark, path, "a", "facts", "fact_ord long").count() == 5 and store.load_payload(spark, path).count() == 5


@pytest.mark.parametrize("run_id", ["run_1", "it's", "a b/c", "실행"])
def test_runs_of_any_id_come_back(spark, tmp_path, run_id):
    path = f"file://{tmp_path}/history"
    store.save(spark, path, runs_of(spark, (run_id, 1), ("other", 2)), payload=payload(spark, run_id, 3))
    assert store.run(spark, path, run_id).first()["id"] == run_id
    assert store.found_by(spark, path, run_id, "facts", "fact_ord long").count() == 3
    assert store.run(spark, path, "' OR '1' = '1").count() == 0
