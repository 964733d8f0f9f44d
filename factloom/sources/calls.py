"""Calls of language models by tasks: a request's providers in order until one answers, and a ledger of every call.

A request is one row whose providers are an array; they are asked in turn, in one task, and those behind the first that answers never.
A failure that may pass (Policy.passing) is tried again after a growing wait, any other moves on to the next provider, as does a blank
answer. Each task begins at most Policy.per_second calls a second, and Policy.tasks tasks run at once.

Every call is an entry of the ledger, a folder of JSON lines by hash bucket of the request. A task reads its buckets before it asks, so
a task that is run again, or the same run started again after a failure, goes on where the ledger ends and pays for no call twice
(at most Policy.flush calls are in no file yet when an executor is lost; two attempts of one task at the same time, as with
speculation, may both ask). An answer counts for all later runs; a failure counts for its own run only, so a new run asks again.

Answers are read from the ledger, never from the rows of the calling job: tables made of them can be worked out any number of times.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import PLAIN_WS
from factloom.operators.models import admitted, first_answers
from factloom.sources.folders import arrow_files, new_folder
from factloom.sources.models import Caller

BUCKETS = 256
LEDGER = "request string, run string, provider_ord int, provider string, model string, attempt int, response string, error string, passing boolean, bucket int"
EMPTY = "returned an empty response."  # fixed value: part of the result rows
_BLANK = re.compile(f"{PLAIN_WS}*")


class Passing(Exception):
    """A caller's failure that may not last, such as a full queue."""


@dataclass(frozen=True)
class Policy:
    attempts: int = 3  # of one provider, as long as its failures may pass
    wait: float = 1.0  # seconds before the second attempt; each further wait is twice as long
    per_second: float | None = None  # calls that a task begins a second
    tasks: int = 32
    flush: int = 1  # calls that are written together
    passing: tuple[type[BaseException], ...] = (Passing, ConnectionError, TimeoutError)


class _Pace:
    """Lets a task begin so many calls a second."""

    def __init__(self, per_second: float | None):
        self.gap, self.next = (1 / per_second if per_second else 0.0), 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


class _Book:
    """A task's view of the ledger: what is known of one bucket's requests, and the entries that are not written yet."""

    def __init__(self, uri: str, flush: int):
        self.files, self.root = arrow_files(uri)
        self.flush_at, self.bucket, self.known, self.open = flush, -1, {}, []

    def of(self, bucket: int, request: str) -> list[dict]:
        """Earlier calls of a request, without their answers' texts."""
        if bucket != self.bucket:
            self.write()
            self.bucket, self.known = bucket, {}
            for entry in self._read(bucket):
                entry["answered"] = entry.pop("response") is not None
                self.known.setdefault(entry["request"], []).append(entry)
        return sorted(self.known.get(request, []), key=lambda e: e["attempt"])

    def _read(self, bucket: int) -> Iterator[dict]:
        from pyarrow import fs

        for found in self.files.get_file_info(fs.FileSelector(f"{self.root}/bucket={bucket}", allow_not_found=True)):
            if found.base_name.endswith(".json") and not found.base_name.startswith("_"):
                with self.files.open_input_stream(found.path) as source:
                    yield from map(json.loads, source.read().decode().splitlines())

    def add(self, entry: dict) -> None:
        self.open.append(entry)
        if len(self.open) >= self.flush_at:
            self.write()

    def write(self) -> None:
        """A file is there whole or not at all: readers skip names that begin with an underscore."""
        if not self.open:
            return
        folder, name = f"{self.root}/bucket={self.bucket}", f"{uuid.uuid4().hex}.json"
        self.files.create_dir(folder, recursive=True)
        with self.files.open_output_stream(f"{folder}/_{name}") as out:
            out.write("".join(json.dumps(e, ensure_ascii=True) + "\n" for e in self.open).encode())
        self.files.move(f"{folder}/_{name}", f"{folder}/{name}")
        self.open = []


def _asked(row: dict, past: list[dict], caller: Caller, policy: Policy, run: str, pace: _Pace) -> Iterator[dict]:
    """The calls that a request still needs, one by one."""
    providers = [p for p in row["providers"] if p["refusal"] is None]
    offered = {(p["provider"], p["model"]) for p in providers}
    if any(e["answered"] and (e["provider"], e["model"]) in offered for e in past):
        return
    for p in providers:
        own = [e for e in past if e["run"] == run and (e["provider"], e["model"]) == (p["provider"], p["model"])]
        if own and not own[-1]["passing"]:
            continue
        for attempt in range(len(own), policy.attempts):
            if attempt:
                time.sleep(policy.wait * 2 ** (attempt - 1))
            pace.wait()
            response, error, passing = None, None, False
            try:
                response = caller(p["provider"], p["model"], row["prompt"])
                if response is None or _BLANK.fullmatch(response):
                    response, error = None, EMPTY
            except Exception as failure:  # a provider's failure is an entry too: another attempt or the next provider follows
                error, passing = str(failure), isinstance(failure, policy.passing)
            yield {"request": row["request"], "run": run, "provider_ord": p["provider_ord"], "provider": p["provider"], "model": p["model"], "attempt": attempt, "response": response, "error": error, "passing": passing}
            if error is None:
                return
            if not passing:
                break


def request_of(keys: list[str]) -> Column:
    """What a request is known by: its keys, prompt and wanted output."""
    return F.sha2(F.to_json(F.struct(*keys, "prompt", "max_output"), {"ignoreNullFields": "false"}), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All calls, each once."""
    return spark.read.schema(LEDGER).json(ledger).dropDuplicates(["request", "run", "provider_ord", "provider", "model", "attempt"])


def call_all(asked: DataFrame, keys: list[str], caller: Caller, ledger: str, policy: Policy, run: str) -> int:
    """Makes the calls that the ledger doesn't have yet, and says how many those were.

    asked(keys, provider_ord, provider, model, prompt, max_output, refusal): a row for each provider of a request.
    """
    provider = F.struct("provider_ord", "provider", "model", "refusal")
    grouped = asked.withColumn("request", request_of(keys)).groupBy("request").agg(F.first("prompt").alias("prompt"), F.array_sort(F.collect_set(provider)).alias("providers"))
    open_ = grouped.where(F.exists("providers", lambda p: p["refusal"].isNull()))
    dealt = open_.withColumn("bucket", F.pmod(F.xxhash64("request"), F.lit(BUCKETS)).cast("int")).repartition(policy.tasks, "bucket").sortWithinPartitions("bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, pace, made = _Book(ledger, policy.flush), _Pace(policy.per_second), 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    for entry in _asked(row, book.of(row["bucket"], row["request"]), caller, policy, run, pace):
                        book.add(entry)
                        made += 1
        finally:
            book.write()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    return dealt.mapInArrow(work, "made long").agg(F.sum("made")).first()[0] or 0


def answered(asked: DataFrame, keys: list[str], caller: Caller, ledger: str | None = None, policy: Policy | None = None, run: str | None = None) -> DataFrame:
    """keys, provider, response, errors: of the first provider that admits the request and answers it. The calls are made here and now.

    asked(keys, provider_ord, provider, model, prompt, extra_tokens, max_output). ledger: where calls are kept, by default a new shared
    folder. run: the same name goes on with a run that broke off.
    """
    spark = asked.sparkSession
    ledger, run = ledger or new_folder(spark, "calls"), run or uuid.uuid4().hex
    checked = admitted(asked).select(*keys, "provider_ord", "provider", "model", "prompt", "max_output", "refusal")
    call_all(checked, keys, caller, ledger, policy or Policy(), run)
    return first_answers(outcomes(checked, keys, ledger, run), keys)


def outcomes(checked: DataFrame, keys: list[str], ledger: str, run: str) -> DataFrame:
    """keys, provider_ord, provider, response, error, n_calls: what became of each provider of a request; those that were not asked have no row."""
    calls = read_ledger(checked.sparkSession, ledger).where(F.col("response").isNotNull() | (F.col("run") == run))
    last = calls.groupBy("request", "provider", "model").agg(F.max(F.struct(F.col("response").isNotNull().alias("good"), "attempt", "response", "error")).alias("last"), F.count(F.lit(1)).alias("n_calls"))
    offers = checked.select(*keys, request_of(keys).alias("request"), "provider_ord", "provider", "model", "refusal").distinct()  # a request that comes twice is one
    met = offers.join(last, ["request", "provider", "model"], "left").where("refusal is not null or n_calls is not null")
    error = F.coalesce(F.concat(F.lit("refused: "), "refusal", F.lit(" tokens")), "last.error")
    return met.select(*keys, "provider_ord", "provider", F.when(F.col("refusal").isNull(), F.col("last.response")).alias("response"), error.alias("error"), F.when(F.col("refusal").isNull(), F.col("n_calls")).otherwise(F.lit(0)).alias("n_calls"))


def compact(spark: SparkSession, ledger: str) -> None:
    """One file a bucket in place of one for each flush, for between runs. A reader in the meantime may see entries twice, which count once."""
    files, root = arrow_files(ledger)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                own = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/bucket={bucket}", allow_not_found=True)) if f.base_name.endswith(".json") and not f.base_name.startswith("_")]
                if len(own) > 1:
                    book = _Book(ledger, 1 << 62)
                    book.bucket, book.open = bucket, list({json.dumps(e, sort_keys=True): e for e in book._read(bucket)}.values())
                    book.write()
                    for path in own:
                        files.delete_file(path)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    spark.range(BUCKETS).repartition(16).mapInArrow(merge, "done long").count()


