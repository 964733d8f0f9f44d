"""What the findings of round 3 led to: costly steps are worked out once, with the same rows."""

import re

from pyspark.sql import functions as F

from factloom.operators import facts, spans
from factloom.plans import pipeline

SHEET = "재무상태표\n(단위 : 천원)\n2023.12.31 현재\n자산총계 1,000 2,000\n부채총계 300 400,000\n자본총계 700,000 1,600\n현금 5,000 6,000"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_parsed_once_and_not_in_the_condition_of_a_join(spark):
    """q49, q46, q48, q22."""
    pages = spark.createDataFrame([("d", 1, SHEET), ("d", 2, "주석")], "document_id string, page_number int, text string")
    candidates = spark.createDataFrame([("d", 0, True, "unknown", "balance_sheet", 1, 2)], "document_id string, candidate_ord int, include boolean, scope string, statement_type string, start_page int, end_page int")
    taken = spans.span_pages(candidates, pages).select("document_id", "candidate_ord", "scope", "statement_type", "page_number", "text")
    found = facts.text_metrics(taken)
    plan = plan_of(found)
    # the pattern that cuts a line into label and values is there once
    assert len(re.findall(r"regexp_extract\(lambda \S+, \(\?s\)\^\(\?:\.\*\[", plan)) == 1
    assert sorted(r.label for r in found.collect()) == ["부채총계", "자본총계", "자산총계", "현금"]


def test_a_review_goes_through_the_pages_once(spark):
    """F8, F10, F12, F13, F17: the kind of report comes out of the same pass over a document's pages as all else."""
    from factloom.operators import review

    texts = ["목 차\n1. 회사의 개요 ..... 2\n재무상태표 3\n사업의 내용 · 기타 9", "사업\n보고서\n회사의 개요", "4-1. 재무상태표\n자산총계 1", "사업의 내용과 기타", "손익계산서 주석\n현금흐름표"]
    pages = spark.createDataFrame([("d", n + 1, t) for n, t in enumerate(texts)] + [("e", n + 1, "x") for n in range(12)] + [("e", 13, "사업보고서")], "document_id string, page_number int, text string")
    documents = spark.createDataFrame([("d", 5), ("e", 13)], "document_id string, page_count int")
    rows = review.reviewed(pages, documents)
    assert plan_of(rows).count("LogicalRDD") == 2
    d, e = sorted(rows.collect(), key=lambda r: r.document_id)
    types = {r.document_id: (r.report_type, r.confidence, r.type_reasons) for r in review.report_types(pages).collect()}
    assert types == {r.document_id: (r.report_type, r.confidence, r.type_reasons) for r in (d, e)}
    assert (d.report_type, e.report_type, d.has_toc, e.has_toc) == ("annual_report", "unknown", True, False)
    assert [(c.title, c.expected_page, c.found_page, c.status) for c in d.checks] == [("회사의 개요", 2, 2, "matched"), ("재무상태표", 3, 3, "matched"), ("사업의 내용 · 기타", 9, None, "missing")]
    assert {s.section: s.found_page for s in d.sections}["사업의내용"] == 4


def test_a_concept_is_found_without_a_case_of_many_branches(spark):
    """the branches of one case are a list, and each is looked up from the list's start."""
    from factloom.functions.amounts import concept

    labels = ["기말현금및현금성자산", "비유동자산", "유동자산 (주)", "총포괄손익 현금및현금성자산", "기타", ""]
    found = spark.createDataFrame([(n, x) for n, x in enumerate(labels)], "n int, label string").select("n", concept(F.col("label")).alias("concept"))
    assert max(case.count(" WHEN ") for case in re.findall(r"CASE WHEN.*?END", plan_of(found))) == 1
    assert [r.concept for r in found.orderBy("n").collect()] == ["CashAndCashEquivalentsEnding", "NoncurrentAssets", "CurrentAssets", "CashAndCashEquivalents", "기타", "UnknownConcept"]


def test_rows_of_an_answer_are_parsed_with_it_and_odd_ones_by_themselves(spark):
    """q36; the plain way and the general one read the same."""
    from factloom.operators import structure

    plain = '{"page": 1, "row_index": "0", "cell_indices": [0, 1]}'
    odd = ['{"row_index":0,"page":1.0,"cell_indices":["0",1]}', '{"page":null,"row_index":0,"cell_indices":[]}', '{"row_index":0}', "5", "null", '{"page":01}']
    refs = spark.createDataFrame([(n, r) for n, r in enumerate([plain, *odd])], "n int, ref string")
    read = refs.select("n", structure._reference(F.col("ref")).alias("r"), structure._parsed_reference(F.col("ref")).alias("p")).orderBy("n").collect()
    assert all(x.r == x.p for x in read)
    assert (read[0].r.page, read[0].r.row_index, read[0].r.cell_indices) == (1, 0, [0, 1]) and read[0].r == read[1].r
    answers = ['{"unit":"won","rows":[{"order":2,"label":"a","notes":["4"]},{"label":"b"}]}', '{"unit":"won","rows":[{"order":2,"label":"a","notes":["4"]},5,null,{"label":"b"}]}', '{"rows":{"label":"a"}}', "[]"]
    told = spark.createDataFrame([("d", n, a) for n, a in enumerate(answers)], "document_id string, candidate_ord int, response string")
    rows = structure.structure_rows(told).orderBy("candidate_ord", "row_pos").collect()
    assert [(r.candidate_ord, r.row_pos, r.order, r.label, r.notes, r.cells) for r in rows] == [(0, 0, 2.0, "a", ["4"], None), (0, 1, 0.0, "b", [], None), (1, 0, 2.0, "a", ["4"], None), (1, 1, 0.0, "", [], None), (1, 2, 0.0, "", [], None), (1, 3, 0.0, "b", [], None)]


def test_answers_are_read_once_to_refine_spans(spark):
    """q61; documents without a segment keep their spans and numbers, those with one are narrowed and numbered anew."""
    from factloom.plans import modelled

    kind = "document_id string, candidate_ord int, include boolean, scope string, statement_type string, start_page int, end_page int, score int, reasons array<string>"
    mine = spark.createDataFrame([("d", 4, True, "unknown", "balance_sheet", 1, 4, 60, ["h"]), ("d", 7, True, "unknown", "balance_sheet", 2, 5, 50, ["h"]), ("d", 9, False, "separate", "income_statement", 1, 1, 10, ["h"]), ("e", 5, True, "unknown", "balance_sheet", 3, 4, 60, ["h"]), ("e", 6, True, "unknown", "balance_sheet", 3, 4, 60, ["h"]), ("f", 0, True, "unknown", "balance_sheet", 1, 2, 60, ["h"])], kind)
    answers = spark.createDataFrame([("d", '{"segments":[{"statement_type":"balance_sheet","scope":"consolidated","start_page":2,"end_page":3,"confidence":0.5},{"statement_type":"balance_sheet","start_page":2,"end_page":3,"confidence":0.9}]}'), ("e", "no answer")], "document_id string, response string")
    documents = spark.createDataFrame([("d", 9), ("e", 9), ("f", 9)], "document_id string, page_count int")
    out = modelled.refined(mine, documents, answers)
    assert plan_of(out).count("try_parse_json") + plan_of(out).count("parseJson") <= 2  # an answer as it stands and from brace to brace
    rows = [(r.document_id, r.candidate_ord, r.scope, r.statement_type, r.start_page, r.end_page, r.score) for r in out.orderBy("document_id", "candidate_ord").collect()]
    assert rows == [("d", 0, "separate", "income_statement", 1, 1, 10), ("d", 1, "unknown", "balance_sheet", 2, 3, 90), ("e", 5, "unknown", "balance_sheet", 3, 4, 60), ("e", 6, "unknown", "balance_sheet", 3, 4, 60), ("f", 0, "unknown", "balance_sheet", 1, 2, 60)]


def test_what_references_found_is_dealt_by_document_once(spark):
    """q36; references and responses are put together without being dealt again."""
    from factloom.operators import structure

    answers = spark.createDataFrame([("d", 0, '{"rows":[{"label":"a","value_cells":{"k":{"page":1,"row_index":0,"cell_indices":[0]}}}]}')], "document_id string, candidate_ord int, response string")
    cells = spark.createDataFrame([("d", 1, 0, 0, 1.0, 2.0, 3.0, 4.0, "7,000")], "document_id string, page_number int, row_index int, cell_index int, x double, y double, width double, height double, text string")
    candidates = answers.select("document_id", "candidate_ord", F.lit("unknown").alias("scope"), F.lit("balance_sheet").alias("statement_type"), F.lit(1).alias("start_page"))
    out = structure.structure_facts(answers, cells, candidates, answers.select("document_id", F.col("document_id").alias("filename")))
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert not [d for d in dealt if "row_pos" in d]
    assert [(r.label, r.value, r.period) for r in out.collect()] == [("a", 7000.0, "k")]


def test_items_that_lie_together_are_not_shuffled(spark):
    """F16: q18, q35; pages that go on in the next Arrow batch, unknown and equal places, and pages without a number read as by the general way."""
    import random

    import __spark_entry__
    from factloom.operators import layout
    from factloom.plans import views

    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    shuffles = plan(views.view(spark, __spark_entry__.SMOKE_DIR, views.items_demo_sql)).count("Exchange hashpartitioning")
    assert plan(__spark_entry__.queries()["q18_first_fit_rows"](spark, __spark_entry__.SMOKE_DIR)).count("Exchange hashpartitioning") == shuffles == 1
    rnd = random.Random(16)
    sizes = {("a", 1): 1, ("a", 2): 2, ("a", 3): 40, ("b", 3): 3, (None, 3): 6, (None, None): 7, ("c", None): 1, ("d", 1): 1, ("e", 1): 4}
    odd = [0.0, -0.0, None, float("nan"), float("inf"), 7.0]
    rows = [(*key, rnd.choice([None, n, n // 3, -n]), rnd.choice(["a", " b", "ㅎ", "z", "", None]) if key != ("d", 1) else " ", *[rnd.choice([*odd, rnd.uniform(0, 20)]) for _ in range(2)], 1.0, rnd.choice([1.0, None])) for key, size in sizes.items() for n in range(size)]
    items = spark.createDataFrame(rows, "document_id string, page_number int, item_ord int, str string, x double, y double, width double, height double")
    apart = items.repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = sorted(map(repr, layout.pages_of(apart).collect()))
    assert len(expected) == len({r[:2] for r in rows if (r[3] or "").strip()})
    try:
        for records in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            for lying in (items.coalesce(1), apart.repartition(3, "document_id", "page_number").sortWithinPartitions("page_number", "document_id")):
                assert sorted(map(repr, layout.pages_of(lying, together=True).collect())) == expected
        assert layout.pages_of(items.where("false"), together=True).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
