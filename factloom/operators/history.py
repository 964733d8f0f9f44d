"""Saved runs as a table: newest first, bounded in number, found again by the files they were made of.

runs(id, created_at, seq, filename, files ARRAY<STRUCT<name, size>>, report_types ARRAY<STRING>, n_candidates, n_facts, n_issues); seq is
the order of saving. What a run found - its candidates, facts, issues and the objects of its document - are rows of their own:
payload(run_id, kind, json). A run of millions of facts is never one value, and a listing reads none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP = 50
PAYLOAD = "run_id string, kind string, json string"
KINDS = ("candidates", "facts", "issues", "document")
SCHEMA = "id string, created_at timestamp, seq long, filename string, files array<struct<name:string,size:long>>, report_types array<string>, n_candidates long, n_facts long, n_issues long"


def normal_runs(runs: DataFrame) -> DataFrame:
    """Defaults for whatever a run lacks."""
    none = F.array()

    def or_else(name: str, default: Column, kind: str) -> Column:
        return (F.coalesce(F.col(name).cast(kind), default) if name in runs.columns else default).cast(kind).alias(name)

    blank = F.nullif(F.col("id"), F.lit("")) if "id" in runs.columns else F.lit(None)
    return runs.select(
        F.coalesce(blank.cast("string"), F.uuid()).alias("id"), or_else("created_at", F.current_timestamp(), "timestamp"), or_else("seq", F.lit(0), "long"),
        (F.coalesce(F.nullif("filename", F.lit("")), F.lit("Untitled extraction")) if "filename" in runs.columns else F.lit("Untitled extraction")).alias("filename"),
        or_else("files", none, "array<struct<name:string,size:long>>"), or_else("report_types", none, "array<string>"), *[or_else(c, F.lit(0), "long") for c in ("n_candidates", "n_facts", "n_issues")],
    )


def saved(history: DataFrame, new: DataFrame, keep: int = KEEP) -> DataFrame:
    """History with the new runs in front: a run replaces one with its id, and the newest `keep` stay."""
    union = history.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest_of_id = W.partitionBy("id").orderBy(F.col("__new").desc(), F.col("seq").desc())
    unique = union.withColumn("__nth", F.row_number().over(newest_of_id)).where("__nth = 1")
    # a top-k over all rows: each task keeps its own best, only those meet
    return unique.orderBy(F.col("__new").desc(), F.col("seq").desc(), "id").limit(keep).drop("__new", "__nth")


def deleted(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti").select(*history.columns)


def find_by_files(history: DataFrame, files: DataFrame) -> DataFrame:
    """files(name, size) with the id of the newest run made of that file, null without one."""
    saved_files = history.select("id", "seq", F.explode("files").alias("file")).groupBy(F.col("file.name").alias("name"), F.col("file.size").alias("size")).agg(F.max(F.struct("seq", "id")).alias("newest"))
    known = files.where("name != '' and size >= 0").distinct()
    return known.join(saved_files, ["name", "size"], "left").select("name", "size", F.col("newest.id").alias("run_id"))


def file_size(total: Column) -> Column:
    t = total.cast("double")
    mega, kilo = [F.call_function("format_number", t / unit, F.lit("0.0")) for unit in (1024 * 1024, 1024)]
    return F.when((total.isNull()) | (total == 0), "").when(total >= 1024 * 1024, F.concat(mega, F.lit(" MB"))).when(total >= 1024, F.concat(kilo, F.lit(" KB"))).otherwise(F.concat(total.cast("string"), F.lit(" B")))


def listing(history: DataFrame) -> DataFrame:
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["size"], F.lit(0)))
    return history.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "filename", F.array_join("report_types", ", ").alias("types"), file_size(total).alias("size"), "n_candidates", "n_facts", "n_issues", "seq")


def payload_of(run_id: Column | str, **tables: DataFrame) -> DataFrame:
    """payload rows of a run's tables, each row as JSON. Their order is what the rows themselves say (fact_ord, candidate_ord), so none is kept."""
    rows = None
    for kind, table in tables.items():
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        json = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        own = table.select((F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), F.lit(kind).alias("kind"), json.alias("json"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def with_counts(runs: DataFrame, payload: DataFrame) -> DataFrame:
    """runs with the numbers of what they found."""
    counts = payload.groupBy(F.col("run_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(f"own_{k}") for k in KINDS[:3]])
    rest = [c for c in runs.columns if c not in ("n_candidates", "n_facts", "n_issues")]
    return runs.join(counts, "id", "left").select(*rest, *[F.coalesce(f"own_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:3]])


def restored(payload: DataFrame, runs: DataFrame, kind: str, schema: str) -> DataFrame:
    """run_id and the rows of one kind, as they were saved, of the given runs(id)."""
    own = payload.where(F.col("kind") == kind).join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return own.select("run_id", F.from_json("json", schema).alias("row")).select("run_id", "row.*")

