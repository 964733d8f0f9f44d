"""Extraction with recorded answers of models, end to end."""

import json

import pytest

from factloom.plans import modelled
from factloom.sources.models import structure_prompts, vision_prompts

CANDIDATES = "document_id string, candidate_ord int, include boolean, scope string, statement_type string, start_page int, end_page int, score int, reasons array<string>"
PROVIDERS = [("gemini", "gemini-1.5-pro"), ("openai", "gpt-4o")]


@pytest.fixture()
def tables(spark):
    text = "2. 재무상태표\n(단위 : 천원)\n자산총계 1,234,567 1,000,000\n부채총계 234,567 200,000\n자본총계 1,000,000 800,000\n"
    pages = spark.createDataFrame([(d, n, text) for d in "abcd" for n in (1, 2, 3)], "document_id string, page_number int, text string")
    documents = spark.createDataFrame([(d, f"{d}.pdf", 3, n) for n, d in enumerate("abcd")], "document_id string, filename string, page_count int, doc_ord long")
    candidates = spark.createDataFrame([(d, 0, True, "separate", "balance_sheet", 1, 2, 90, ["t"]) for d in "abc"] + [("d", 0, True, "separate", "equity_changes", 1, 1, 90, ["t"])], CANDIDATES)
    cells = spark.createDataFrame([("b", 1, 0, 0, 10.0, 5.0, 9.0, 2.0, "자산"), ("b", 1, 0, 1, 30.0, 5.0, 9.0, 2.0, "77")], "document_id string, page_number int, row_index int, cell_index int, x double, y double, width double, height double, text string")
    return pages, documents, candidates, cells


def segments(a, b):
    return json.dumps({"segments": [{"statement_type": "balance_sheet", "scope": "separate", "start_page": a, "end_page": b, "confidence": 0.99}]})


def test_segments_narrow_spans_and_failures_leave_them(spark, tables):
    _, documents, candidates, _ = tables
    answers = spark.createDataFrame([("a", segments(2, 3)), ("b", "no JSON"), ("c", json.dumps({"segments": []}))], "document_id string, response string")
    got = {r["document_id"]: (r["scope"], r["start_page"], r["end_page"], r["score"]) for r in modelled.refined(candidates, documents, answers).collect()}
    assert got == {"a": ("separate", 2, 2, 99), "b": ("separate", 1, 2, 90), "c": ("separate", 1, 2, 90), "d": ("separate", 1, 1, 90)}


def test_requests_are_admitted_asked_and_fall_back(spark, tables):
    pages, documents, candidates, _ = tables
    none = spark.createDataFrame([], "document_id string, title string, found_page int, expected_page int")
    asked = modelled.segment_requests(pages, documents, candidates, none, PROVIDERS)
    assert asked.count() == 8

    answer = segments(1, 1)

    def caller(provider, model, prompt):
        payload = json.loads(prompt[prompt.index("\n") + 1 :])
        if provider == "gemini" and len(payload["candidates"]) and payload["candidates"][0]["statement_type"] == "balance_sheet":
            raise ValueError("down")
        return answer if provider == "openai" else " "

    got = modelled.answers(asked, ["document_id"], caller)
    rows = {r["document_id"]: (r["provider"], r["errors"]) for r in got.collect()}
    assert rows["a"] == ("openai", None) and rows["d"][0] == "openai"
    narrowed = {r["document_id"]: (r["start_page"], r["end_page"]) for r in modelled.refined(candidates, documents, got).collect()}
    assert narrowed == {"a": (1, 1), "b": (1, 1), "c": (1, 1), "d": (1, 1)}
    images = candidates.selectExpr("document_id", "candidate_ord", "CAST(IF(document_id = 'a', 3000000, 10) AS LONG) AS tokens")
    refused = modelled.answers(modelled.vision_requests(candidates, documents, images, PROVIDERS[1:]), ["document_id", "candidate_ord"], lambda *_: "{}")
    assert {r["document_id"]: r["errors"] for r in refused.collect()} == {"a": "openai: refused: input tokens", "b": None, "c": None, "d": None}


def test_tiers_of_facts_fall_back_span_by_span(spark, tables):
    pages, documents, candidates, cells = tables
    keys = "document_id string, candidate_ord int, response string"
    seen = json.dumps({"unit": "won", "columns": [{"key": "2024", "label": "당기"}], "rows": [{"order": 1, "label": "자산총계", "values": {"2024": "55"}}]})
    pointed = json.dumps({"unit": "won", "columns": [{"key": "2024", "label": "당기"}], "rows": [{"order": 1, "label": "자산총계", "value_cells": {"2024": {"page": 1, "row_index": 0, "cell_indices": [1]}}}]})
    vision = spark.createDataFrame([("a", 0, seen), ("b", 0, "broken"), ("zz", 0, seen)], keys)
    structure = spark.createDataFrame([("a", 0, pointed), ("b", 0, pointed), ("c", 0, "{}")], keys)
    got = {}
    for r in modelled.modelled(pages, documents, candidates, cells, vision, structure).collect():
        got.setdefault(r["document_id"], []).append((r["label"], r["value"]))
    assert got["a"] == [("자산총계", 55.0)] and got["b"] == [("자산총계", 77.0)]
    assert ("자산총계", 1_234_567_000.0) in got["c"] and set(got) >= {"a", "b", "c"}


def test_prompts_speak_of_their_statement(spark, tables):
    _, documents, candidates, _ = tables
    evidence = spark.createDataFrame([(d, 0, 1, 3, 2, ["2024"], ["r"]) for d in "ad"], "document_id string, candidate_ord int, page_number int, row_count int, numeric_row_count int, column_bands array<string>, rows array<string>")
    for prompts in (structure_prompts(evidence, candidates), vision_prompts(candidates, documents)):
        told = {r["document_id"]: r["prompt"] for r in prompts.collect()}
        assert "components of equity" in told["d"] and "components of equity" not in told["a"] and "displayed periods" in told["a"]
