"""Reports as they land: documents whose pages are all there go through the batch pipeline, micro-batch by micro-batch.

A document's pages may come in several files. They wait in the state of their document until there are as many as its page count says,
or until nothing of it has come for a while. The state holds what is on its way, at most a document a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.plans.pipeline import text_pipeline
from factloom.sources.folders import delete, new_folder

PAGES = "document_id string, page_number int, text string"
PARTS = f"{PAGES}, page_count int"
ASSEMBLED = f"{PAGES}, whole boolean"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
Sink = Callable[[dict[str, DataFrame], int], None]


def assembled(parts: DataFrame, wait_seconds: float = 600.0) -> DataFrame:
    """Streaming parts(document_id, page_number, text, page_count) as the pages of documents: document_id, page_number, text, whole.

    Of a page that comes twice the first counts. A document without a page count, or with pages that never come, is given after
    wait_seconds without news of it, with whole false; what comes of it later is a document of its own again.
    """

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, count = state.get if state.exists else ([], [], 0)
        held = dict(zip(numbers, texts, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                for number, text, pages in zip(frame["page_number"], frame["text"], frame["page_count"], strict=True):
                    held.setdefault(int(number), text)
                    count = max(count, 0 if pd.isna(pages) else int(pages))
            if not 0 < count <= len(held):
                state.update((list(held), list(held.values()), count))
                state.setTimeoutDuration(int(wait_seconds * 1000))
                return
        state.remove()
        if held:
            yield pd.DataFrame({"document_id": key[0], "page_number": list(held), "text": list(held.values()), "whole": 0 < count <= len(held)})

    whole = parts.where("document_id is not null and page_number is not null")
    return whole.groupBy("document_id").applyInPandasWithState(gather, ASSEMBLED, "numbers array<int>, texts array<string>, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(spark: SparkSession, landing: str, checkpoint: str, sink: Sink, files_per_batch: int = 1000, wait_seconds: float | None = None, pipeline: Callable[..., dict[str, DataFrame]] = text_pipeline, every: str | None = None) -> StreamingQuery:
    """Runs the pipeline over Parquet files of pages that land in a folder: until all that are there are done, or, with an interval such
    as "1 minute" in every, on and on.

    A file holds whole documents; with wait_seconds, pages have a page_count and a document may be spread over files (assembled()).
    sink(tables, batch_id) writes by batch_id, so a batch that is run again after a failure overwrites what it wrote before; a batch
    without pages gives it nothing. What a batch keeps for itself, its pages and facts, is gone when the sink returns.
    pipeline(pages, folder=...) makes the tables. Documents that have waited too long are given with the next batch; only a stream that
    runs on and on makes batches without files for them.
    """
    files = spark.readStream.schema(PAGES if wait_seconds is None else PARTS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    pages = files if wait_seconds is None else assembled(files, wait_seconds)

    def batch(rows: DataFrame, batch_id: int) -> None:
        folder = new_folder(spark, f"landing-{batch_id}")
        try:
            # several tables are made of the pages, which a stateful batch must not work out twice
            rows.write.parquet(f"{folder}/pages")
            again = spark.read.schema(rows.schema).parquet(f"{folder}/pages")
            if again.limit(1).count():
                sink(pipeline(again.select("document_id", "page_number", "text"), folder=folder) | {"pages": again}, batch_id)
        finally:
            delete(spark, folder)

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    # state that waits for the clock asks for one batch without files after another, so a stream of what is there would never end
    before = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_NO_DATA, before)
