"""The history table on storage, for several writers at once.

<path>/versions/v<n>.json names a version's rows and the payload parts that they use; <path>/runs/<name> holds the rows (bounded by the
runs that are kept), <path>/payload/part=<name> what the runs of one save found. A save appends its own payload and copies no other's.
A version is there whole or not at all, and only one writer gets its number: the others read the new version, apply their change to it
and take the next number. What no recent version uses is removed once it is old enough to be in no writer's hands.

The file system's rename must fail on an existing file in one step, as HDFS's does; on a local disk a hard link takes its place.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.history import KEEP, PAYLOAD, SCHEMA, deleted, normal_runs, restored, saved, with_counts
from factloom.sources.folders import delete as delete_folder
from factloom.sources.folders import hadoop

STORED = f"{SCHEMA}, part string"
KEPT_VERSIONS = 3
UNUSED_SECONDS = 3600.0
TRIES = 100


def _names(spark: SparkSession, folder: str) -> list:
    files, found = hadoop(spark, folder)
    return list(files.listStatus(found)) if files.exists(found) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    names = [s.getPath().getName() for s in _names(spark, f"{path}/versions")]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/versions/v{version:08d}.json").collect()))  # one line


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Writes a version unless it is there already; says whether it did."""
    target, draft = f"{path}/versions/v{version:08d}.json", f"{path}/versions/_{uuid.uuid4().hex}"
    files, drafted = hadoop(spark, draft)
    out = files.create(drafted, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    if files.getScheme() == "file":
        local = lambda p: hadoop(spark, p)[1].toUri().getPath()
        try:
            os.link(local(draft), local(target))
            done = True
        except FileExistsError:
            done = False
    else:
        done = not files.exists(hadoop(spark, target)[1]) and files.rename(drafted, hadoop(spark, target)[1])
    files.delete(drafted, False)
    return done


def _stored(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, rows with the part of each) of the newest version; -1 and no rows where there is none or it can't be read."""
    found = versions(spark, path)
    if found:
        try:
            return found[-1], spark.read.schema(STORED).parquet(f"{path}/runs/{_manifest(spark, path, found[-1])['runs']}")
        except (AnalysisException, ValueError, KeyError):
            return found[-1], spark.createDataFrame([], STORED)
    return -1, spark.createDataFrame([], STORED)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; an empty table where there is none or it can't be read."""
    return _stored(spark, path)[1].drop("part")


def _payload(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The payload of these stored rows. Their parts are few and known, so only those folders are read."""
    parts = [r["part"] for r in rows.where("part is not null").select("part").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], PAYLOAD)
    found = spark.read.schema(f"{PAYLOAD}, part string").parquet(f"{path}/payload").where(F.col("part").isin(parts))
    return found.join(F.broadcast(rows.select(F.col("id").alias("run_id"), "part")), ["run_id", "part"], "left_semi").drop("part")


def load_payload(spark: SparkSession, path: str) -> DataFrame:
    """What the newest version's runs found: run_id, kind, json."""
    return _payload(spark, path, _stored(spark, path)[1])


def _changed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a change to the newest version until it is the first to follow it."""
    for n in range(TRIES):
        version, before = _stored(spark, path)
        name = uuid.uuid4().hex
        change(before).select(*[c.split(" ")[0] for c in STORED.split(", ")]).coalesce(1).write.parquet(f"{path}/runs/{name}")
        parts = [r[0] for r in spark.read.schema(STORED).parquet(f"{path}/runs/{name}").where("part is not null").select("part").distinct().collect()]
        if _publish(spark, path, version + 1, {"runs": name, "parts": sorted(parts)}):
            return load(spark, path)
        delete_folder(spark, f"{path}/runs/{name}")
        time.sleep(random.uniform(0, 0.05 * min(n + 1, 20)))
    raise RuntimeError(f"{TRIES} other versions came first")


def save(spark: SparkSession, path: str, runs: DataFrame, keep: int = KEEP, payload: DataFrame | None = None) -> DataFrame:
    """History with the new runs. payload: what they found; their counts are taken from it. Runs with a payload have an id.

    A run that replaces one and has no payload keeps the old one's.
    """
    new, part = normal_runs(runs), uuid.uuid4().hex
    if payload is not None:
        payload.select("run_id", "kind", "json").join(new.select(F.col("id").alias("run_id")), "run_id", "left_semi").write.parquet(f"{path}/payload/part={part}")
        own = spark.read.schema(PAYLOAD).parquet(f"{path}/payload/part={part}")
        new = with_counts(new, own).join(own.select(F.col("run_id").alias("id"), F.lit(part).alias("own_part")).distinct(), "id", "left")
    else:
        new = new.withColumn("own_part", F.lit(None).cast("string"))

    def change(before: DataFrame) -> DataFrame:
        old = before.select("id", "part")
        placed = new.join(old, "id", "left").withColumn("part", F.coalesce("own_part", "part")).drop("own_part")
        return saved(before, placed, keep)

    out = _changed(spark, path, change)
    vacuum(spark, path)
    return out


def delete(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    out = _changed(spark, path, lambda before: deleted(before, ids))
    vacuum(spark, path)
    return out


def vacuum(spark: SparkSession, path: str, kept: int = KEPT_VERSIONS, unused: float = UNUSED_SECONDS) -> list[str]:
    """Removes versions but the newest `kept`, and rows and payload parts that none of these uses and that are at least `unused` seconds old."""
    found = versions(spark, path)
    used: set[str] = set()
    for version in found[-kept:]:
        try:
            manifest = _manifest(spark, path, version)
            used |= {manifest["runs"], *[f"part={p}" for p in manifest["parts"]]}
        except (AnalysisException, ValueError, KeyError):
            return []  # what it uses isn't known
    gone, now = [], time.time()
    for version in found[:-kept]:
        delete_folder(spark, f"{path}/versions/v{version:08d}.json")
    for folder in ("runs", "payload"):
        for status in _names(spark, f"{path}/{folder}"):
            name = status.getPath().getName()
            if name not in used and now - status.getModificationTime() / 1000 >= unused:
                delete_folder(spark, f"{path}/{folder}/{name}")
                gone.append(f"{folder}/{name}")
    return gone


def found_by(spark: SparkSession, path: str, run_id: str, kind: str, schema: str) -> DataFrame:
    """A saved run's candidates, facts, issues or document, as they were."""
    own = _stored(spark, path)[1].where(F.col("id") == F.lit(run_id))
    return restored(_payload(spark, path, own), own, kind, schema).drop("run_id")


def run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return load(spark, path).where(F.col("id") == F.lit(run_id))


def clear(spark: SparkSession, path: str) -> None:
    delete_folder(spark, path)
