"""Pages of reports to facts, issues and the assembled document, without any model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import facts as X
from factloom.operators.spans import MAX_SPAN, discover_spans, pages_with_spans


def documents_of(pages: DataFrame) -> DataFrame:
    """documents(document_id, filename, page_count, doc_ord) where none are given; their order is that of a hash, so no global sort is needed."""
    docs = pages.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    return docs.select("document_id", F.col("document_id").alias("filename"), "page_count", F.xxhash64("document_id").bitwiseAND(F.lit((1 << 39) - 1)).alias("doc_ord"))


def extracted(pages: DataFrame, candidates: DataFrame, documents: DataFrame, *better: DataFrame) -> DataFrame:
    """Facts of confirmed spans: of the first tier that has any (better tiers first, the text last), filtered and numbered."""
    text = X.metrics_to_facts(X.text_metrics(X.parsed_span_pages(pages_with_spans(candidates, pages))), documents)
    return X.numbered(X.filtered_cash_flow(X.first_tier(*better, text)), documents)


def text_pipeline(pages: DataFrame, documents: DataFrame | None = None, span: int = MAX_SPAN, folder: str | None = None) -> dict[str, DataFrame]:
    """candidates, facts, issues and the objects of the assembled document.

    Issues and objects are made of the facts: whoever wants more than one table names a folder, to which the facts are written once.
    """
    documents = documents_of(pages) if documents is None else documents
    candidates = discover_spans(pages, span)
    facts = extracted(pages, candidates, documents)
    if folder:
        facts = written(facts, f"{folder}/facts")
    return {"candidates": candidates, "facts": facts, "issues": X.balance_issues(facts), "document": X.document_json(facts)}


def written(rows: DataFrame, path: str) -> DataFrame:
    """rows, written as Parquet and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
