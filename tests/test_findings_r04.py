"""What the findings of round 4 led to: less is shuffled and worked out again, with the same rows."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from factloom.operators import evidence


def plan_of(frame, kind: str = "optimizedPlan") -> str:
    return getattr(frame._jdf.queryExecution(), kind)().toString()


def test_pages_that_are_candidates_of_their_own_meet_no_others(spark):
    """q35; bands of a page alone are those that a window over its candidate finds, numbers that look like years included."""
    texts = [["과목 2024 2023", "자산 1,000 2,000", "부채 - (5)"], ["자산 1,000 2,000", "부채 3,000 4,000 20"], ["주석 당기 제2(전)기 2,024", "현금 7 20241 전전기"], ["없음"], []]
    cell = "struct<cell_index:int,x:double,y:double,width:double,height:double,text:string>"
    pages = spark.createDataFrame(
        [("d", n, n, [(r, 800.0 - 14 * r, [(k, 60.0 + 50.004 * k, 800.0 - 14 * r, 30.0, 10.0, f" {word}　") for k, word in enumerate(line.split(" "))]) for r, line in enumerate(lines)]) for n, lines in enumerate(texts)],
        f"document_id string, candidate_ord int, page_number int, item_rows array<struct<row_index:int,y:double,cells:array<{cell}>>>",
    )
    told = evidence.evidence_pages(pages)
    met, alone = evidence.annotated(told), evidence.annotated(told, alone=True)
    assert "Window" in plan_of(met) and "Window" not in plan_of(alone)
    assert met.schema == alone.schema
    rows = alone.orderBy("page_number").collect()
    assert rows == met.orderBy("page_number").collect()
    assert [[b.key for b in r.column_bands] for r in rows] == [["2024", "2023"], ["period_1", "period_2", "period_3"], ["current", "prior", "2024", "prior_2"], [], []]
    assert [[c.value_column for c in r.cells] for r in rows[0].rows] == [[None, "2024", "2023"]] * 3
    # whether a cell is a number is told once
    assert plan_of(alone).count(r"(?:-|\(?\d+") == 1


def test_small_tables_are_dealt_to_all_tasks(spark):
    """q35 and q18; of orders, a few bytes each, pages of items are made, so adaptive execution may not join their partitions."""
    plan = plan_of(__spark_entry__.queries()["q35_evidence_rows"](spark, __spark_entry__.SMOKE_DIR), "executedPlan")
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "REPARTITION_BY_NUM" in plan


def test_a_page_of_several_spans_is_parsed_once(spark):
    """q46 (q48, q49 too); a page in two spans gives each its rows, of its own slice or of the whole page."""
    from factloom.operators import facts, spans
    from factloom.plans import pipeline

    texts = ["재무상태표\n(단위 : 천원)\n2023.12.31 현재\n자산총계 1,000 2,000\n손익계산서\n매출액 3,000", "현금 5,000 6,000\n현금 5,000 7,000\n주석 1,000\nPage 2 1,000", "목차"]
    pages = spark.createDataFrame([("d", n + 1, t) for n, t in enumerate(texts)], "document_id string, page_number int, text string")
    kind = "document_id string, candidate_ord int, include boolean, scope string, statement_type string, start_page int, end_page int"
    candidates = spark.createDataFrame([("d", 0, True, "unknown", "balance_sheet", 1, 2), ("d", 1, True, "separate", "income_statement", 1, 3), ("d", 2, False, "unknown", "cash_flow_statement", 2, 2), ("d", 3, True, "unknown", "equity_changes", 2, 9)], kind)
    keys = ["document_id", "candidate_ord", "scope", "statement_type", "page_number"]
    each = facts.text_metrics(spans.span_pages(candidates, pages).select(*keys, "text"))
    once = facts.text_metrics(facts.parsed_span_pages(spans.pages_with_spans(candidates, pages)))
    assert sorted(map(repr, once.select(*each.columns).collect())) == sorted(map(repr, each.collect()))
    assert sorted((r.candidate_ord, r.page_number, r.label) for r in once.collect()) == [(0, 1, "자산총계"), (0, 2, "현금"), (1, 1, "매출액"), (1, 2, "현금"), (3, 2, "현금")]
    assert spans.pages_with_spans(candidates, pages).count() == 3
    # the whole path parses a page below where its spans are taken out
    plan = plan_of(pipeline.extracted(pages, candidates, pipeline.documents_of(pages)))
    assert plan.index("explode(knownnotcontainsnull(filter(spans") < plan.index(r"(?s)^(?:.*[") and plan.count(r"(?s)^(?:.*[") == 1


def test_labels_are_put_in_lower_case_where_their_letters_matter(spark):
    """q46; parts in Latin letters are found in either case, whatever the script around them."""
    from factloom.functions.rows import is_account

    labels = {"자산총계": True, "PAGE 1": False, "쪽 pAgE": False, "DART.FSS.OR.KR": False, "Dart.fss.or.kr 공시": False, "영업 이익 p": True, "a.b": True, "주 석": False, "자산": False}
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", is_account(F.col("label")).alias("a")).collect()
    assert {r.label: r.a for r in rows} == labels
