"""Values derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import amounts, rows, statements, text
from factloom.functions.json import json_text
from factloom.operators import display, evidence


def values(spark, inputs, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").withColumn("out", make(F.col("v")))
    return [r["out"] for r in frame.orderBy("i").collect()]


CASES = [
    (amounts.parsed_number, {"(1,234)": -1234, "1,234.5": 1234.5, "-1,234": -1234, "-": None, "": None, "abc": None, ".": None, "△1,234": 1234, "(-5)": 5, "1.2.3": 1.2, "12-3": 12, "5-": 5, None: None, "　(7) ": -7, "(0)": 0}),
    (lambda v: amounts.amount(v, F.lit("천원")), {"1,234": 1234000, "(2)": -2000, "-": None}),
    (lambda v: amounts.amount(v, F.lit("?"), F.lit(7)), {"1,234": 8638}),
    (amounts.unit_label, {"hundred_million_KRW": "백만원", "thousand_KRW": "천원", "won": "KRW", "USD": "USD", None: "KRW", "십억원": "억원", "백 만 원": "백만원", " ": "KRW"}),
    (amounts.concept, {"기말현금및현금성자산": "CashAndCashEquivalentsEnding", "부채와자본총계": "Equity", "자본과부채총계": "Liabilities", "기타비유동자산": "NoncurrentAssets", "무엇": "무엇", "": "UnknownConcept", None: "UnknownConcept", "자산　총계 (주)": "Assets", "\\uc790\\uc0b0\\ucd1d\\uacc4": "Assets", "x" * 100: "x" * 80, "영업활동으로인한현금흐름": "영업활동으로인한현금흐름"}),
    (text.compact, {" A　b﻿\nC ": "abc", None: ""}),
    (text.squeezed, {" A　 b\n": " a b ", None: ""}),
    (text.number_of, {"": 0, "1e3": 1000, "1d": None, "-.5": -0.5, "x": None}),
    (statements.title_type, {"2-1. 연결 재무상태표": "balance_sheet", "5. 재무상태표": None, "재무상태표 관련 주석": None, "포괄손익계산서\n": "income_statement", "balance sheet": None, "1-5. 자본변동표": None, "포괄자본변동표": None, "별도현금흐름표": "cash_flow_statement", "x" * 60: None}),
    (statements.heading_scope, {"1. 연결재무제표 4. 재무제표": "separate", "4. 재무제표 2. 연결 재무제표": "consolidated", "34. 재무제표 주석": None, "별도 재무제표 주석": "separate", "nothing": None, "x 34. 재무제표": "separate"}),
    (statements.starts_other_section, {"\n\n 3. 연결 재무제표 주석": True, "주석 1": True, "재무상태표\n주석": False, "": False, None: False, "외부감사 실시내용": True}),
    (lambda v: text.rounded(v.cast("double")), {"1.005": 1.0, "2.345": 2.35, "-0.025": -0.02, None: 0.0}),
    (lambda v: rows.period(v, F.lit("balance_sheet")), {"2024.12.31 현재": "2024.12.31", "제 57 기": "제57기", "": ""}),
    (lambda v: rows.period(v, F.lit("income_statement")), {"2024.01.01 부터\n2024.12.31 까지": "FY2024", "2024.12.31": ""}),
    (rows.is_account, {"자산": False, "현재가치할인차금": False, "매출채권": True, "A": False, "1,234 원": False, "제5기": False, "2024.1": False, "ab": True, "§§§": False}),
    (display.formatted, {"n/a": "0", "-5": "(5)", "(1,234)": "(1,234)", "-": "-", "": "", None: "", "1234567": "1,234,567", "1.2.3": "1.2.3", "1.5": "1.5"}),
    (display.is_suspicious, {"2024": True, "당기": True, "자본금": False, "": True, "Column 3": True}),
    (evidence.is_numeric_cell, {"-": True, "500": True, "(5)": True, "1,234": True, "1,23": False, "a": False, None: False}),
    (evidence.period_key, {"2024년": "2024", "전전기": "prior_2", "제5(전)기": "prior", "당기": "current", "x": None}),
    (json_text, {'```json\n{"a": 1}\n```': '{"a": 1}', 'so: {"a": 1} done': '{"a": 1}', "{broken": None, "": None, None: None, "[1]": "[1]"}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    make, expected = CASES[case]
    assert values(spark, list(expected), make) == list(expected.values())


def test_parsed_line(spark):
    lines = ["매출채권 5,16 1,234,000 987,000", "Ⅰ. 유동자산 1,000 -", "현금 500", "1,000", "CD 예금 1,000", "가 1,000 2,000 3,000 4,000", "", None]
    got = values(spark, lines, rows.parsed_line)
    assert [None if r is None else (r["label"], r["values"]) for r in got] == [("매출채권", ["1,234,000", "987,000"]), ("유동자산", ["1,000", "-"]), None, None, ("예금", ["1,000"]), ("가", ["1,000", "2,000", "3,000"]), None, None]


def test_slices(spark):
    page = "재무상태표\n자산총계 1,000\n손익계산서\n매출액 2,000"
    frame = spark.createDataFrame([(page,)], "text string").withColumn("lines", text.lines(F.col("text")))
    frame = frame.withColumn("titles", statements.titles(F.col("lines")))
    made = [statements.statement_slice(F.col("text"), F.col("lines"), F.col("titles"), F.lit(k)).alias(k) for k in ("balance_sheet", "income_statement", "cash_flow_statement")]
    assert frame.select(*made).first() == ("재무상태표\n자산총계 1,000", "손익계산서\n매출액 2,000", "")


def test_titles_with_section_numbers(spark):
    page = "1. 재무상태표\na\n2. 재무상태표\nb\n손익계산서"
    frame = spark.createDataFrame([(page,)], "text string").withColumn("lines", text.lines(F.col("text")))
    frame = frame.withColumn("titles", statements.titles(F.col("lines")))
    got = frame.select(statements.statement_slice(F.col("text"), F.col("lines"), F.col("titles"), F.lit("balance_sheet"))).first()[0]
    assert got == "2. 재무상태표\nb"


def test_clusters_and_empty_ranges(spark):
    frame = spark.createDataFrame([([0.0, 10.0, 20.0, 21.0, 60.0, 70.0],), ([],)], "v array<double>")
    assert [r[0] for r in frame.select(evidence.clusters(F.col("v"))).collect()] == [[5.0, 20.5, 65.0], []]
    assert spark.range(1).select(text.page_range(F.lit(5), F.lit(3))).first()[0] == []


def test_long_numbering_is_cut(spark):
    """A run of points behind the numbering once overflowed the pattern's stack."""
    assert values(spark, ["I" + "." * 30_000 + " 매출"], rows.clean_label) == ["매출"]


def test_slices_share_the_look_at_their_page(spark):
    page = "재무상태표\n자산총계 1,000 2,000\n부채총계 1,000 -"
    seen = statements.look_at_slice(F.col("v"), F.col("v"), statements.look(F.col("v")))
    (got,) = values(spark, [page], lambda v: statements.shown(seen, "balance_sheet"))
    assert (got["rows"], got["numbers"], got["valued"], got["goes_on"], got["strong"]) == (4, 3, 2, True, False)


def test_a_cell_s_whitespace_is_looked_at_once(spark):
    one = spark.createDataFrame([(" 제 5(전)　기\t",)], "x string")
    for rule, cleaner in ((evidence.period_key, "regexp_replace("), (lambda c: evidence.row_kind(c, F.lit(0)), "regexp_replace("), (evidence.is_numeric_cell, "trim(")):
        made = one.select(rule(F.col("x")).alias("y"))
        assert made._jdf.queryExecution().analyzed().toString().count(cleaner) == 1
    assert one.select(evidence.period_key(F.col("x"))).first()[0] == "prior"
    assert one.select(evidence.is_numeric_cell(F.lit("　(1,234.5)﻿"))).first()[0]
