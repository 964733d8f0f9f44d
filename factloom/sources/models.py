"""The boundary to language models: requests go out as rows and come back as rows. No client is part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Caller = Callable[[str, str, str], str]  # provider, model, prompt -> response


def segment_prompts(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """document_id, prompt: the pages of a document's broad range and its candidate spans, asked for segments."""
    page = F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages")
    span = F.array_sort(F.collect_list(F.struct("candidate_ord", "statement_type", "scope", "start_page", "end_page"))).alias("candidates")
    joined = pages.groupBy("document_id").agg(page).join(candidates.groupBy("document_id").agg(span), "document_id")
    task = 'Split these pages of a Korean financial report into its four core statements. Answer in JSON only, as {"segments": [{"statement_type", "scope", "start_page", "end_page", "start_anchor", "end_anchor", "confidence", "reason"}]}. Leave out notes, and stay within the candidate spans.\n'
    return joined.select("document_id", F.concat(F.lit(task), F.to_json(F.struct("pages", "candidates"))).alias("prompt"))


#: What a request says of the columns and the rows of a statement, by its type; "" is any other.
COLUMN_RULES = {
    "equity_changes": "Columns are components of equity, named as displayed, with header words of several rows joined; dates and periods are row labels. ",
    "": "Columns are the displayed periods. ",
}
ROW_RULES = {
    "cash_flow_statement": "Rows go from operating activities to the cash at the end; notes on the same page are left out. ",
    "": "Rows of notes and of other statements are left out. ",
}
STATEMENT_NAMES = {
    "balance_sheet": "statement of financial position",
    "income_statement": "statement of (comprehensive) income",
    "cash_flow_statement": "statement of cash flows",
    "equity_changes": "statement of changes in equity",
}


def _rules(kind: Column) -> Column:
    def told(rules: dict[str, str]) -> Column:
        known = [n for n in rules if n]
        return F.coalesce(*[F.when(kind == n, F.lit(rules[n])) for n in known], F.lit(rules[""]))

    return F.concat(told(COLUMN_RULES), told(ROW_RULES))


def structure_prompts(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """document_id, candidate_ord, prompt: the table evidence of a span, asked for references to its cells - never for numbers."""
    page = F.array_sort(F.collect_list(F.struct("page_number", "row_count", "numeric_row_count", "column_bands", "rows"))).alias("pages")
    span = F.struct("statement_type", "scope", "start_page", "end_page", "pages")
    task = 'Name the columns and account rows of this table. Answer in JSON only, as {"unit", "columns": [{"key", "label"}], "rows": [{"order", "label", "notes", "value_cells": {"key": {"page", "row_index", "cell_indices"}}}]}. Point to cells, all that a split value has, in reading order; never write amounts. A label and values wrapped over rows are one row. '
    joined = evidence.groupBy("document_id", "candidate_ord").agg(page).join(candidates.select("document_id", "candidate_ord", "statement_type", "scope", "start_page", "end_page"), ["document_id", "candidate_ord"])
    return joined.select("document_id", "candidate_ord", F.concat(F.lit(task), _rules(F.col("statement_type")), F.lit("\n"), F.to_json(span)).alias("prompt"))


def vision_prompts(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, candidate_ord, prompt: a span's page images, which the caller attaches, asked for all rows as they are printed."""
    task = 'Read every account row of the named statement in the attached page images, as one table over all pages. Keep Korean labels and printed values as they are, with commas, parentheses and dashes; never calculate. Note numbers go to notes. Answer in JSON only, as {"unit", "columns": [{"key", "label"}], "rows": [{"order", "label", "depth", "notes", "values": {"key": "text"}}]}, with depth 0 for top rows. '
    joined = candidates.join(documents.select("document_id", "filename", "page_count"), "document_id")
    names = F.create_map(*[F.lit(x) for pair in STATEMENT_NAMES.items() for x in pair])
    asked = F.struct("filename", "page_count", "start_page", "end_page", "statement_type", F.coalesce(F.try_element_at(names, F.col("statement_type")), F.col("statement_type")).alias("statement"), "scope")
    return joined.select("document_id", "candidate_ord", F.concat(F.lit(task), _rules(F.col("statement_type")), F.lit("\n"), F.to_json(asked)).alias("prompt"))


def ask(requests: DataFrame, caller: Caller) -> DataFrame:
    """requests(..., provider, provider_ord, model, prompt) that were admitted, with response and error of each."""
    kept = [f for f in requests.schema.fields if f.name != "prompt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", response string, error string"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for row in batch.itertuples(index=False):
                try:
                    answers.append((caller(row.provider, row.model, row.prompt), None))
                except Exception as error:  # a provider's failure is an answer too: the next provider is asked
                    answers.append((None, str(error)))
            out = batch.drop(columns="prompt")
            out["response"], out["error"] = [a for a, _ in answers], [e for _, e in answers]
            yield out

    return requests.mapInPandas(call, schema)
