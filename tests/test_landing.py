"""Pages that land in files, document by document."""

import os
import time

from factloom.plans.pipeline import written
from factloom.streaming.landing import PARTS, watch

TEXT = "text"


def land(spark, folder, name, *rows):
    """One file, newer than those before."""
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (time.time() + 10 * len(os.listdir(folder)) - 1000,) * 2)


def run(spark, tmp_path, wait):
    seen = {}

    def sink(tables, batch_id):
        pages = sorted((r["document_id"], r["page_number"], r["whole"]) for r in tables["pages"].collect())
        seen[batch_id] = (pages, {r["document_id"] for r in tables["texts"].collect()})

    def texts(pages, folder):
        return {"texts": written(pages, f"{folder}/texts")}

    query = watch(spark, f"{tmp_path}/in", f"{tmp_path}/checkpoint", sink, files_per_batch=1, wait_seconds=wait, pipeline=texts)
    assert query.awaitTermination(90)
    return seen


def test_documents_that_come_in_several_files(spark, tmp_path):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    land(spark, f"{tmp_path}/in", "1", ("a", 1, "x", 3), ("a", 3, TEXT, 3), ("b", 1, TEXT, 1), ("c", 1, TEXT, 2))
    land(spark, f"{tmp_path}/in", "2", ("a", 2, TEXT, 3), ("a", 3, "again", 3))
    land(spark, f"{tmp_path}/in", "3", ("d", 1, TEXT, None), ("e", 1, TEXT, 1), (None, 1, TEXT, 1))
    got = run(spark, tmp_path, 3600.0)
    assert [pages for pages, _ in got.values()] == [[("b", 1, True)], [("a", 1, True), ("a", 2, True), ("a", 3, True)], [("e", 1, True)]]
    assert [documents for _, documents in got.values()] == [{"b"}, {"a"}, {"e"}]
    land(spark, f"{tmp_path}/in", "4", ("c", 2, "y", 2))
    assert [pages for pages, _ in run(spark, tmp_path, 3600.0).values()] == [[("c", 1, True), ("c", 2, True)]]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    assert not [f for f in os.listdir(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")) if f.startswith("landing-")]


def test_documents_that_wait_too_long(spark, tmp_path):
    land(spark, f"{tmp_path}/in", "1", ("a", 1, TEXT, 2), ("b", 2, TEXT, None))
    assert run(spark, tmp_path, 0.5) == {}
    time.sleep(1)
    land(spark, f"{tmp_path}/in", "2", ("z", 1, TEXT, 1))
    pages = [p for pages, _ in run(spark, tmp_path, 0.5).values() for p in pages]
    assert sorted(pages) == [("a", 1, False), ("b", 2, False), ("z", 1, True)]
