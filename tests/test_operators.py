"""Operators on small documents, with results derived by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts, history, layout, models, order, review, spans, structure
from factloom.plans.pipeline import text_pipeline

BALANCE = "재무상태표\n(단위: 천원)\n2024.12.31 현재\n자산총계 1,000 2,000\n부채총계 1,600 1,200\n자본총계 1,400 1,800"


def pages(spark, *texts, document="d"):
    return spark.createDataFrame([(document, i + 1, t) for i, t in enumerate(texts) if t is not None], "document_id string, page_number int, text string")


def documents(spark, *names, page_count=9):
    return spark.createDataFrame([(n, f"{n}.pdf", page_count, i) for i, n in enumerate(names)], "document_id string, filename string, page_count int, doc_ord long")


def test_a_page_scores_by_rows_and_numbers(spark):
    got = spans.scored_pages(pages(spark, BALANCE)).select("scored.*").first()
    assert (got["score"], got["rows"], got["numbers"]) == (96, 6, 6)


def test_spans_end_before_notes_and_titles(spark):
    found = spans.discover_spans(pages(spark, BALANCE, "자산 1,000 2,000", "재무제표 주석\n1. 일반", "끝"))
    assert [(r["statement_type"], r["start_page"], r["end_page"], r["reasons"][0]) for r in found.collect()] == [("balance_sheet", 1, 2, "재무상태표")]


def test_a_title_alone_starts_at_the_page_that_goes_on(spark):
    body = BALANCE.split("\n", 1)[1]
    found = spans.discover_spans(pages(spark, "재무상태표", body, "끝", None, "끝")).first()
    assert (found["start_page"], found["end_page"]) == (2, 5)


def test_scope_carries_on(spark):
    got = spans.with_carried_scope(pages(spark, "x", "2. 연결재무제표", "y", "4. 재무제표", "z")).orderBy("page_number").collect()
    assert [r["context_scope"] for r in got] == [None, "consolidated", "consolidated", "separate", "separate"]


def test_a_segment_narrows_a_span_and_never_widens_it(spark):
    schema = "document_id string, candidate_ord int, include boolean, scope string, statement_type string, start_page int, end_page int, score int, reasons array<string>"
    mine = spark.createDataFrame([("d", 0, True, "consolidated", "balance_sheet", 10, 13, 96, ["a"]), ("d", 1, True, "separate", "equity_changes", 3, 4, 50, ["b"])], schema)
    theirs = spark.createDataFrame([("d", 0, True, "unknown", "balance_sheet", 12, 15, 90, ["m"])], schema)
    got = spans.reconciled(mine, theirs).orderBy("start_page").collect()
    assert [(r["scope"], r["start_page"], r["end_page"], r["score"]) for r in got] == [("separate", 3, 4, 50), ("consolidated", 12, 13, 96)]
    assert got[1]["reasons"][-1] == "llm_range_clamped_to_heuristic"


def test_edits_and_broad_pages(spark):
    found = spans.discover_spans(pages(spark, BALANCE))
    edits = spark.createDataFrame([("d", 0, False, None)], "document_id string, candidate_ord int, include boolean, start_page int")
    assert spans.edited(found, edits).first()["include"] is False
    ranges = spark.createDataFrame([("d", 1, 3)], "document_id string, start_page int, end_page int")
    got = spans.broad_pages(pages(spark, "a" * 20, "b", "c"), ranges, max_pages=2, max_chars=5).orderBy("page_number").collect()
    assert [r["text"] for r in got] == ["aaaaa\n[TRUNCATED]", "b"]


def test_balance_tolerance_last_wins_and_null(spark):
    def issues(*rows):
        table = spark.createDataFrame([("s", "p", c, v, i) for i, (c, v) in enumerate(rows)], "scope string, period string, concept string, value double, fact_ord long")
        return facts.balance_issues(table).collect()

    assert issues(("Assets", 100.0), ("Liabilities", 60.0), ("Equity", 39.0)) == []
    assert len(issues(("Assets", 100.0), ("Liabilities", 60.0), ("Equity", 38.99))) == 1
    last = issues(("Assets", 100.0), ("Liabilities", 60.0), ("Equity", 40.0), ("Equity", 100.0))[0]
    assert (last["expected"], last["actual"], last["difference"]) == (160, 100, -60)
    assert issues(("Assets", 100.0), ("Liabilities", 60.0), ("Equity", 1.0), ("Equity", None)) == []
    assert issues(("Assets", 100.0), ("Liabilities", float("nan")), ("Equity", 1.0)) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_pipeline_does_not_depend_on_partitions(spark, parts):
    both = pages(spark, BALANCE).unionByName(pages(spark, BALANCE.replace("1,400", "1,401"), document="e")).repartition(parts)
    got = text_pipeline(both, documents(spark, "d", "e"))
    rows = [(r["document_id"], r["concept"], r["value"], r["extraction_order"]) for r in got["facts"].orderBy("fact_ord").collect()]
    assert rows[:3] == [("d", "Assets", 1e6, 0), ("d", "Liabilities", 1.6e6, 1), ("d", "Equity", 1.4e6, 2)] and rows[5] == ("e", "Equity", 1.401e6, 2)
    issue = got["issues"].first()
    assert (issue["actual"], issue["expected"]) == (1e6, 1.6e6 + 1.401e6)
    kinds = {r["kind"]: r["n"] for r in got["document"].groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"schema": 1, "context": 1, "unit": 1, "fact": 6}


def test_empty_tables(spark):
    got = text_pipeline(pages(spark, BALANCE).where("false"), documents(spark, "d"))
    assert [got[k].count() for k in ("candidates", "facts", "issues")] == [0, 0, 0]


def test_cash_flow_filter(spark):
    labels = ["단위", "영업활동현금흐름", "주주명", "재무활동현금흐름", "기말현금및현금성자산", "지분율"]
    table = spark.createDataFrame([("d", 0, "cash_flow_statement", i, x) for i, x in enumerate(labels)], "document_id string, candidate_ord int, statement_type string, row_ord int, label string")
    assert sorted(r["row_ord"] for r in facts.filtered_cash_flow(table).collect()) == [1, 3, 4]
    assert facts.filtered_cash_flow(table.withColumn("statement_type", F.lit("balance_sheet"))).count() == 6


def test_first_tier_and_order_after_filter(spark):
    schema = "document_id string, candidate_ord int, label string"
    first, second = spark.createDataFrame([("d", 0, "a")], schema), spark.createDataFrame([("d", 0, "b"), ("d", 1, "c")], schema)
    assert sorted(r["label"] for r in facts.first_tier(first, second).collect()) == ["a", "c"]


def test_first_fit_rows(spark):
    ys = [100.0, 102.0, 104.0, 97.5, 95.0]
    rows = [("d", 1, i, f"w{i}", float(-i), y, 5.0, 1.0) for i, y in enumerate(ys)] + [("d", 1, 9, " ", 0.0, 50.0, 1.0, 1.0), ("d", 1, 10, None, 0.0, 50.0, 1.0, 1.0)]
    items = spark.createDataFrame(rows, "document_id string, page_number int, item_ord int, str string, x double, y double, width double, height double")
    page = layout.pages_of(items).first()
    assert [(r["row_index"], r["y"]) for r in page["item_rows"]] == [(0, 104.0), (1, 100.0), (2, 95.0)]
    assert page["text"] == "w2\nw3 w1 w0\nw4"


def test_contents_and_checks(spark):
    toc = "목차\n1. 회사의 개요 ..... 5\nCredit risk 12\n재무상태표 2\n없는 항목 7\n회사의 개요 5"
    book = pages(spark, toc, "재무상태표 관련", "재무상태표", "x", "y", "회사의 개요")
    found = review.review(book, documents(spark, "d"))
    checks = {r["title"]: (r["expected_page"], r["found_page"], r["status"]) for r in found["toc_checks"].collect()}
    assert checks == {"회사의 개요": (5, 6, "near"), "redit risk": (12, None, "missing"), "재무상태표": (2, 3, "near"), "없는 항목": (7, None, "missing")}
    assert found["status"].first()["status"] == "error"
    messages = [r["message"] for r in found["review_issues"].orderBy("issue_ord").collect()]
    assert messages[0].startswith("Document type") and messages[1:] == ["TOC entry check failed: redit risk", "TOC entry check failed: 없는 항목"]


def test_report_type_tie_is_annual(spark):
    got = review.report_types(pages(spark, "사업보고서", "감사 보고서")).first()
    assert (got["report_type"], round(got["confidence"], 2)) == ("annual_report", 0.65)


def test_structure_reads_cells_and_drops_bad_references(spark):
    cells = spark.createDataFrame([("d", 1, 0, 0, 10.0, 5.0, 4.0, 2.0, "1,2"), ("d", 1, 0, 1, 15.0, 5.0, 4.0, 2.0, "34"), ("d", 1, 1, 0, 10.0, 9.0, 4.0, 2.0, "-")], "document_id string, page_number int, row_index int, cell_index int, x double, y double, width double, height double, text string")
    answer = '{"unit": "천 원", "rows": [{"label": "자산총계", "value_cells": {"2025": {"page": 1, "row_index": 0, "cell_indices": [0, 1]}, "2024": {"page": 1, "row_index": 1, "cell_indices": [0]}, "x": {"page": 3, "row_index": 0, "cell_indices": [0]}}}, {"label": " ", "value_cells": {}}]}'
    responses = spark.createDataFrame([("d", 0, answer)], "document_id string, candidate_ord int, response string")
    candidates = spark.createDataFrame([("d", 0, "separate", "balance_sheet", 1)], "document_id string, candidate_ord int, scope string, statement_type string, start_page int")
    got = structure.structure_facts(responses, cells, candidates, documents(spark, "d")).collect()
    assert [(r["label"], r["period"], r["all_values"], r["value"], r["unit"]) for r in got] == [("자산총계", "2024", ["-", "1,234"], None, "천원")]
    read = structure.read_references(structure.references(structure.structure_rows(responses)), cells)
    assert {r["column_key"]: (r["valid"], r["bbox"]) for r in read.collect()} == {"2025": (True, [10.0, 5.0, 19.0, 7.0]), "2024": (True, [10.0, 9.0, 14.0, 11.0]), "x": (False, None)}
    warnings = structure.structure_warnings(structure.structure_rows(responses), read)
    assert sorted(r["warning"] for r in warnings.collect()) == ["Dropped invalid cell reference for 자산총계 / x.", "Dropped row without label or value_cells."]


def test_segments_null_page_is_one_and_missing_page_drops(spark):
    answer = '{"segments": [{"statement_type": "balance_sheet", "start_page": null, "end_page": 99, "confidence": 0.905}, {"statement_type": "balance_sheet", "end_page": 2}, {"statement_type": "notes", "start_page": 1, "end_page": 2}]}'
    responses = spark.createDataFrame([("d", answer)], "document_id string, response string")
    got = spans.normal_segments(responses, documents(spark, "d")).collect()
    assert [(r["scope"], r["start_page"], r["end_page"], r["score"]) for r in got] == [("unknown", 1, 9, 91)]


def test_history_on_storage(spark, tmp_path):
    from factloom.sources import history as store

    path = f"file://{tmp_path}/history"
    assert store.load(spark, path).count() == 0
    runs = spark.createDataFrame([("a", 1, [("f.pdf", 10)]), ("b", 2, [("f.pdf", 10)]), ("c", 3, [])], "id string, seq long, files array<struct<name:string,size:long>>")
    assert store.save(spark, path, runs, keep=2).count() == 2
    again = store.save(spark, path, runs.where("id = 'b'").withColumn("seq", F.lit(9)), keep=2)
    assert sorted((r["id"], r["seq"]) for r in again.collect()) == [("b", 9), ("c", 3)]
    files = spark.createDataFrame([("f.pdf", 10), ("g.pdf", 1)], "name string, size long")
    assert {r["name"]: r["run_id"] for r in history.find_by_files(again, files).collect()} == {"f.pdf": "b", "g.pdf": None}
    found = spark.createDataFrame([(1, "자산", None), (0, "부채", 2.5)], "fact_ord long, label string, value double")
    payload = history.payload_of("c", facts=found, issues=found.select("label")).unionByName(history.payload_of("lost", facts=found))
    store.save(spark, path, runs.where("id = 'c'").withColumn("seq", F.lit(10)), keep=2, payload=payload)
    assert {r["id"]: (r["n_candidates"], r["n_facts"], r["n_issues"]) for r in store.load(spark, path).collect()} == {"b": (0, 0, 0), "c": (0, 2, 2 - 0)}
    back = store.found_by(spark, path, "c", "facts", "fact_ord long, label string, value double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, found.collect())) and store.load_payload(spark, path).where("run_id = 'lost'").count() == 0
    store.save(spark, path, runs.where("id = 'c'").withColumn("seq", F.lit(11)), keep=2, payload=history.payload_of("c", facts=found.where("fact_ord = 0")))
    assert store.found_by(spark, path, "c", "facts", "label string").count() == 1 and store.found_by(spark, path, "c", "issues", "label string").count() == 0
    assert store.delete(spark, path, spark.createDataFrame([("b",)], "id string")).count() == 1
    assert store.found_by(spark, path, "c", "facts", "label string").first()["label"] == "부채"
    assert store.run(spark, path, "c").count() == 1 and history.listing(store.load(spark, path)).first()["size"] == ""
    store.clear(spark, path)
    assert store.load(spark, path).count() == 0


def test_admission_and_fallback(spark):
    asked = spark.createDataFrame([("gemini", "gemini-1.5-pro", "x" * 9, None, 16_384), ("openai", "gpt-4o", "x", 128_000, None), ("openai", "new", "x" * 4, None, None)], "provider string, model string, prompt string, extra_tokens long, max_output long")
    got = {r["model"]: (r["estimated_input"], r["requested_output"], r["refusal"]) for r in models.admitted(asked).collect()}
    assert got == {"gemini-1.5-pro": (3, 16_384, "output"), "gpt-4o": (128_001, 8_192, "input"), "new": (1, 8_192, None)}
    answers = spark.createDataFrame([(1, "p", 0, " ", None), (1, "q", 1, "yes", None), (2, "p", 0, None, "down")], "k int, provider string, provider_ord int, response string, error string")
    best = {r["k"]: (r["provider"], r["response"], r["errors"]) for r in models.first_answers(answers, ["k"]).collect()}
    assert best == {1: ("q", "yes", None), 2: (None, None, "p: down")}
    assert models.preferred_providers({"openai": "k", "gemini": ""}, {"openai": "m"}) == [("openai", "m")]


def test_first_wins_is_idempotent(spark):
    table = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, o int")
    once = order.first_wins(table, ["k"], "o")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, order.first_wins(once, ["k"], "o").collect())) == [(1, 1), (2, 5)]


def test_files_landing_folder_and_models(spark, tmp_path):
    from factloom.sources import models as ask
    from factloom.sources import reports
    from factloom.streaming.landing import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.PDF").write_bytes(b"1")
    (tmp_path / "in" / "b.pdf").write_bytes(b"bad")
    (tmp_path / "in" / "c.txt").write_bytes(b"1")
    again = history.normal_runs(spark.createDataFrame([("r1", [("A.PDF", 1)])], "id string, files array<struct<name:string,size:long>>"))
    read = reports.ingested(spark, f"file://{tmp_path}/in", lambda content: [(int(content), 0, "x", 1.0, 2.0, 3.0, 4.0)], again)
    assert read["skipped"].first()["run_id"] == "r1" and read["items"].count() == 0 and read["errors"].count() == 1
    fresh = reports.ingested(spark, f"file://{tmp_path}/in", lambda content: [(int(content), 0, "x", 1.0, 2.0, 3.0, 4.0)], again.where("false"))
    assert [(r["filename"], r["file_size"], r["page_count"]) for r in fresh["documents"].collect()] == [("A.PDF", 1, 1)] and fresh["errors"].count() == 1
    pages(spark, BALANCE).coalesce(1).write.parquet(f"{tmp_path}/landing")
    seen = []
    watch(spark, f"{tmp_path}/landing", f"{tmp_path}/checkpoint", lambda tables, n: seen.append((n, tables["issues"].count()))).awaitTermination(120)
    assert seen == [(0, 1)]
    requests = spark.createDataFrame([(1, "p", 0, "m", "hi"), (2, "q", 0, "m", "")], "k int, provider string, provider_ord int, model string, prompt string")

    def caller(provider, model, prompt):
        if not prompt:
            raise ValueError("empty")
        return prompt.upper()

    assert {r["k"]: (r["response"], r["error"]) for r in ask.ask(requests, caller).collect()} == {1: ("HI", None), 2: (None, "empty")}


def test_rows_of_pages_equal_first_fit_over_all_rows(spark):
    import random

    rnd = random.Random(4)
    rows = [(f"d{k % 3}", k % 4, k, rnd.choice([" a ", "b", "", None, "ㅎ"]), rnd.choice([None, float(rnd.randrange(40))]), rnd.choice([rnd.uniform(-30, 60), float(rnd.randrange(20)), None, 7.0]), 5.0, 2.0) for k in range(900)]
    items = spark.createDataFrame(rows, "document_id string, page_number int, item_ord int, str string, x double, y double, width double, height double")
    expected = set()
    for key in {r[:2] for r in rows}:
        anchors, held = [], []
        for _, _, item_ord, text, x, y, _, _ in (r for r in rows if r[:2] == key and (r[3] or "").strip()):
            y = y or 0.0
            near = [n for n, a in enumerate(anchors) if abs(a - y) < 3]
            n = near[0] if near else len(anchors)
            if not near:
                anchors.append(y)
                held.append([])
            held[n].append((x or 0.0, item_ord, text.strip(), y))
        for row_index, n in enumerate(sorted(range(len(anchors)), key=lambda n: (-anchors[n], n))):
            expected |= {(*key, row_index, anchors[n], k, x, text, y) for k, (x, _, text, y) in enumerate(sorted(held[n]))}
    cells = layout.cells_of(layout.pages_of(items.repartition(5)))
    got = [(r.document_id, r.page_number, r.row_index, r.row_y, r.cell_index, r.x, r.text, r.y) for r in cells.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert layout.pages_of(items.where("false")).count() == 0
    assert layout.first_fit([100, 102, 104, 97.5, 95])[0] == [0, 0, 1, 0, 2] and layout.first_fit([float("nan"), 1.0, float("inf"), float("inf")])[0] == [0, 1, 2, 3]
