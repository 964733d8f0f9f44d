"""From a folder of report files to saved runs, in one call: read, review, find spans, let models refine and read them, check, assemble, save.

Each step writes its table below a work folder and the next one reads it there, so no step is worked out twice, and a step that fails
leaves what came before it. Models are asked through the ledger in that folder under the run's name: starting a run again that broke off
pays for no call twice. Without a caller the text alone is read. Whatever goes wrong with one file, document or span is a row of the log
and costs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence, facts, history, layout, review, spans
from factloom.operators.structure import CANDIDATE, vision_facts
from factloom.plans import modelled
from factloom.plans.pipeline import written
from factloom.sources import history as store
from factloom.sources.calls import Policy
from factloom.sources.documents import write_document
from factloom.sources.folders import delete
from factloom.sources.models import Caller
from factloom.sources.reports import Decoder, ingested

LOG = "document_id string, step string, level string, message string"


def run_of(run: str, document_id: Column) -> Column:
    """The id of what a run saves for a document: a run of any number of files is never one row."""
    return F.concat(F.lit(f"{run}:"), document_id)


def _log(step: str, rows: DataFrame, message: Column, level: Column | str = "info") -> DataFrame:
    return rows.select("document_id", F.lit(step).alias("step"), (F.lit(level) if isinstance(level, str) else level).alias("level"), message.alias("message"))


def _answer_log(step: str, responses: DataFrame) -> DataFrame:
    return _log(step, responses.where("errors is not null"), F.col("errors"), "error")


def process(spark: SparkSession, path: str, decoder: Decoder, work: str, run: str, saved_runs: str | None = None, caller: Caller | None = None, providers: modelled.Providers = (), policy: Policy | None = None, image_tokens: DataFrame | None = None, edits: DataFrame | None = None, span: int = spans.MAX_SPAN, keep: int = history.KEEP) -> dict[str, DataFrame]:
    """documents, reviews, candidates, facts, issues, log of the new files below path; the assembled document is in <work>/document.

    saved_runs: the folder of the history (sources.history); files that it knows are skipped, and a saved run is added for each document.
    image_tokens(document_id, candidate_ord, tokens): asked for by spans whose page images the caller attaches. edits: spans.edited().
    """
    ledger = f"{work}/calls"
    known = store.load(spark, saved_runs) if saved_runs else history.normal_runs(spark.createDataFrame([], "id string, files array<struct<name:string,size:long>>"))
    read = ingested(spark, path, decoder, known, f"{work}/ingest")
    documents = read["documents"]
    pages = written(layout.pages_of(read["items"]), f"{work}/pages")
    texts = pages.select("document_id", "page_number", "text")
    reviews = written(review.reviewed(texts, documents), f"{work}/reviews")
    found = written(spans.discover_spans(texts, span), f"{work}/found")
    log = [
        _log("upload", read["skipped"], F.concat("filename", F.lit(": same name and size as in run "), "run_id")),
        _log("upload", read["errors"], F.concat(F.lit("upload failed. "), "error"), "error"),
        _log("review", reviews, F.concat("report_type", F.when(F.col("has_toc"), ", contents found").otherwise(", contents not found"))),
        _log("spans", documents.select("document_id").join(found.groupBy("document_id").count(), "document_id", "left"), F.concat(F.coalesce("count", F.lit(0)).cast("string"), F.lit(" spans found by the text"))),
    ]

    candidates = found
    if caller:
        asked = modelled.segment_requests(texts, documents, found, review.contents_checks(reviews), list(providers))
        segments = modelled.answers(asked, ["document_id"], caller, ledger, policy, f"{run}-segments")
        candidates = written(modelled.refined(found, documents, segments), f"{work}/refined")
        log.append(_answer_log("segments", segments))
    if edits is not None:
        candidates = written(spans.edited(candidates, edits), f"{work}/edited")
    confirmed = candidates.where("include")

    vision = structure = None
    if caller and image_tokens is not None:
        vision = modelled.answers(modelled.vision_requests(confirmed, documents, image_tokens, list(providers)), CANDIDATE, caller, ledger, policy, f"{run}-vision")
        log.append(_answer_log("vision", vision))
    if caller:
        # only spans of which no image was read are asked about by their cells
        seen = vision_facts(vision.select(*CANDIDATE, "response"), confirmed, documents).select(*CANDIDATE).distinct() if vision is not None else None
        left = confirmed if seen is None else confirmed.join(seen, CANDIDATE, "left_anti")
        own = left.select(*CANDIDATE, "start_page", "end_page").join(pages.select("document_id", "page_number", "item_rows"), "document_id").where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
        table = written(evidence.annotated(evidence.evidence_pages(own)), f"{work}/evidence")
        structure = modelled.answers(modelled.structure_requests(table, left, list(providers)), CANDIDATE, caller, ledger, policy, f"{run}-structure")
        log.append(_answer_log("structure", structure))

    rows = written(modelled.modelled(texts, documents, candidates, layout.cells_of(pages), vision, structure), f"{work}/facts")
    issues = written(facts.balance_issues(rows, by=("document_id", "scope", "period")), f"{work}/issues")
    delete(spark, f"{work}/document")  # of a run that broke off
    write_document(facts.document_objects(rows), f"{work}/document")
    counts = rows.groupBy("document_id").agg(F.count("*").alias("n_facts")).join(issues.groupBy("document_id").agg(F.count("*").alias("n_issues")), "document_id", "left")
    log.append(_log("extraction", documents.select("document_id").join(counts, "document_id", "left"), F.concat(F.coalesce("n_facts", F.lit(0)).cast("string"), F.lit(" facts, "), F.coalesce("n_issues", F.lit(0)).cast("string"), F.lit(" issues"))))

    if saved_runs:
        key = run_of(run, F.col("document_id"))
        runs = documents.join(reviews.select("document_id", "report_type"), "document_id", "left").select(key.alias("id"), F.col("doc_ord").alias("seq"), "filename", F.array(F.struct(F.col("filename").alias("name"), F.col("file_size").alias("size"))).alias("files"), F.array("report_type").alias("report_types"))
        shown = confirmed.join(documents.select("document_id", "filename"), "document_id").select("document_id", "filename", "scope", "statement_type", "start_page", "end_page")
        store.save(spark, saved_runs, runs, keep, history.payload_of(key, candidates=shown, facts=rows, issues=issues))
        log.append(_log("history", documents, F.lit("saved")))
    everything = log[0]
    for part in log[1:]:
        everything = everything.unionByName(part)
    return {"documents": documents, "reviews": reviews, "candidates": candidates, "facts": rows, "issues": issues, "log": written(everything.select("document_id", "step", "level", "message"), f"{work}/log")}
