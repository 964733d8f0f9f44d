"""Report tables made of the provided ones, by the same formulas in Spark SQL and in DuckDB SQL.

The provided tables hold no reports, so orders become pages of reports, lineitems and orders become facts and amounts. A formula is
written once; what the two dialects spell differently (grouped digits, casts) is filled in by `Dialect`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]


@dataclass(frozen=True)
class Dialect:
    name: str

    def grouped(self, number: str) -> str:
        """1,234,567"""
        return f"format_number({number}, 0)" if self.name == "spark" else f"format('{{:,}}', ({number})::BIGINT)"

    def newline(self) -> str:
        return "'\\n'" if self.name == "spark" else "chr(10)"

    def values(self, rows: list[tuple], columns: str) -> str:
        def cell(x) -> str:
            if x is None:
                return "NULL"
            if isinstance(x, bool | int | float):
                return str(x)
            if self.name == "spark":
                return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
            return "'" + x.replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)
        return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")

#: What a page shows, by the number of its order modulo 12. {a} to {d} are amounts with commas, {y} and {z} years, {n} the number.
PAGES = {
    0: ["연결 재무상태표", "(단위 : 천원)", "{y}.12.31 현재", "{z}. 12. 31", "과목 {y} {z}", "Ⅰ. 유동자산 {a} -", "매출채권 5,16 {a} {b}", "현금 500", "자산총계 {a} {b}", "부채총계 {b} {c}", "자본총계 {c} {d}", "무엇인가 ({d}) 0"],
    1: ["2-1. 연결 재무상태표", "(단위: 백만원)", "{y}-12-31", "자산총계 {a} {b}", "비유동자산 {b} {d}", "부채총계 {b} {c}", "자본총계 {d} {c}", "현재가치할인차금 ({c})"],
    2: ["포괄손익계산서", "{z}.01.01 부터 {y}.12.31 까지", "매출액 {a} {b}", "매출원가 ({b}) ({c})", "매출총이익 {c} {d}", "영업이익 {d} -", "당기순이익 {c} {b}"],
    3: ["현금흐름표", "제 {n} 기", "단위 {a}", "영업활동현금흐름 {a} {b}", "투자활동현금흐름 ({b}) {c}", "주주명 {c} {d}", "재무활동으로인한현금흐름 {d} {a}", "기말현금및현금성자산 {a} {b}", "지분율 {a}"],
    4: ["4-4. 자본변동표", "자본금 {a} {b} {c} {d}", "이익잉여금 {b} {c} {d} {a}", "기말자본 {c} {d} {a}"],
    5: ["3. 재무제표 주석", "1. 일반사항", "회사의 개요 및 기타 {a}", "주석 {b} {c}"],
    6: ["자본잉여금 {a} {b}", "배당금지급 ({c}) -", "재무활동현금흐름 {a} {b}", "기말의 현금 {c} {d}", "자산총계 {a}"],
    7: ["목 차", "1. 회사의 개요 ..... 3", "사업의 내용  4", "Credit risk 6", "재무상태표 2", "II. 재무에 관한 사항 - 9", "손익계산서 {n}"],
    8: ["2. 연결재무제표", "회사의 개요", "재무에 관한 사항", "당기 {a}"],
    9: ["손익계산서", "사업의 내용"],
    10: ["별도 재무상태표", "({y}년) 단위:억원", "자산총계 {a} {c}", "부채총계 {c} {b}", "자본총계 {b} {d}", "기타비유동자산 {d} {a}", "부채와자본총계 {a} {c}"],
    11: ["사업보고서 {y}", "4. 재무제표", "감사보고서 첨부", "임원 {n}", "credit risk"],
}


def _page_text(dialect: Dialect) -> str:
    grouped = {k: dialect.grouped(e) for k, e in {"a": "p * 3 + 1000000", "b": "p * 2 + 1000", "c": "p + 999000", "d": "k * 7 + 4200"}.items()}
    parts = grouped | {"y": "CAST(2019 + k % 5 AS STRING)", "z": "CAST(2018 + k % 5 AS STRING)", "n": "CAST(1 + k % 60 AS STRING)"}

    def line(template: str) -> str:
        pieces, rest = [], template
        while rest:
            before, brace, after = rest.partition("{")
            if before:
                pieces.append("'" + before + "'")
            if brace:
                pieces.append(parts[after[0]])
                rest = after[2:]
            else:
                rest = ""
        return "concat(" + ", ".join(pieces) + ")"

    cases = " ".join(f"WHEN {kind} THEN concat_ws({dialect.newline()}, {', '.join(map(line, rows))})" for kind, rows in PAGES.items())
    return f"CASE k % 12 {cases} END"


def report_pages_sql(dialect: Dialect) -> str:
    """document_id, page_number, text: a customer is a document, its orders are its pages; every ninth page number is missing."""
    return f"""(SELECT document_id, page_number, {_page_text(dialect)} AS text FROM (
        SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, CAST(nth + CAST(floor((nth - 1) / 8) AS INT) AS INT) AS page_number, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) numbered) keyed)"""


def report_documents_sql(dialect: Dialect) -> str:
    """document_id, filename, page_count, doc_ord"""
    return """(SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, concat('report-', CAST(o_custkey AS STRING), '.pdf') AS filename, CAST(count(*) + floor((count(*) - 1) / 8) AS INT) AS page_count, o_custkey AS doc_ord FROM orders GROUP BY o_custkey)"""


def facts_demo_sql(dialect: Dialect) -> str:
    """Three facts an order: assets, liabilities and equity by scope and year; fact_ord is unique."""
    return """(SELECT scope, period, concept, CASE concept WHEN 'Assets' THEN assets WHEN 'Liabilities' THEN net ELSE tax END AS value, 3 * o_orderkey + n AS fact_ord FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'separate' ELSE 'unknown' END AS scope, concat('FY', CAST(year(o_orderdate) AS STRING)) AS period,
            CASE WHEN o_orderkey % 2 = 0 THEN net + tax ELSE o_totalprice END AS assets, net, tax
        FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * l_tax), 2) AS tax FROM lineitem GROUP BY l_orderkey) sums ON o_orderkey = l_orderkey) priced
        CROSS JOIN (SELECT * FROM (VALUES ('Assets', 0), ('Liabilities', 1), ('Equity', 2)) AS v(concept, n)) three)"""


def amount_strings_sql(dialect: Dialect) -> str:
    """Totals of orders as cells write them."""
    shown = dialect.grouped("CAST(floor(o_totalprice) AS BIGINT)")
    return f"""(SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN {shown} WHEN 1 THEN concat('(', {shown}, ')') WHEN 2 THEN '-' WHEN 3 THEN concat({shown}, '.5') WHEN 4 THEN concat(' △', {shown}, ' ') WHEN 5 THEN concat('(-', CAST(o_orderkey AS STRING), ')') WHEN 6 THEN concat(CAST(o_orderkey AS STRING), '-1') ELSE '' END AS raw,
        CASE o_orderkey % 5 WHEN 0 THEN 'KRW' WHEN 1 THEN '천원' WHEN 2 THEN '백만원' WHEN 3 THEN '억원' ELSE 'USD' END AS unit, CAST(1 + o_orderkey % 3 AS BIGINT) AS scale FROM orders)"""


def scope_marks_sql(dialect: Dialect) -> str:
    return """(SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'consolidated' WHEN 'purchase' THEN 'separate' END AS detected FROM events)"""


def spans_demo_sql(dialect: Dialect) -> str:
    """Orders as spans of a customer's document."""
    return """(SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, CAST(o_orderkey AS INT) AS candidate_ord, o_orderkey % 3 <> 0 AS include, CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'separate' ELSE 'unknown' END AS scope,
        CASE o_orderkey % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow_statement' ELSE 'equity_changes' END AS statement_type,
        CAST(1 + o_orderkey % 9 AS INT) AS start_page, CAST(1 + o_orderkey % 9 + o_orderkey % 5 - 1 AS INT) AS end_page, CAST(floor(o_totalprice) AS INT) % 120 AS score FROM orders)"""


def segments_demo_sql(dialect: Dialect) -> str:
    """Lineitems' orders again as what a model might have answered: other scopes, ranges and scores."""
    return """(SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, CAST(o_orderkey AS INT) AS candidate_ord, CASE (o_orderkey + o_custkey) % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' ELSE 'unknown' END AS scope,
        CASE (o_orderkey + 1) % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow_statement' ELSE 'equity_changes' END AS statement_type,
        CAST(1 + (o_orderkey * 7) % 10 AS INT) AS start_page, CAST(1 + (o_orderkey * 7) % 10 + o_orderkey % 4 AS INT) AS end_page, CAST(50 + o_orderkey % 50 AS INT) AS score FROM orders)"""


def cells_demo_sql(dialect: Dialect) -> str:
    """Lineitems as the cells of their order's tables, a document an order: in the order of all their values, two cells a row, two rows a page."""
    return """(SELECT document_id, CAST(floor((nth - 1) / 4) AS INT) + 1 AS page_number, CAST(floor((nth - 1) % 4 / 2) AS INT) AS row_index, CAST((nth - 1) % 2 AS INT) AS cell_index, 60.0 + 110.0 * ((nth - 1) % 2) + jitter AS x, 800.0 - 14.0 * floor((nth - 1) % 4 / 2) AS y, 40.0 + jitter AS width, 10.0 AS height, text FROM (
        SELECT concat('O', CAST(l_orderkey AS STRING)) AS document_id, CAST(l_partkey % 13 AS DOUBLE) AS jitter, CASE l_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN concat('항목 ', l_returnflag) WHEN 2 THEN '(1,234)' ELSE CAST(l_partkey AS STRING) END AS text,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS nth
        FROM lineitem) numbered)"""


def items_demo_sql(dialect: Dialect) -> str:
    """The words of the report pages as positioned items, lines 14 apart, words of a line up to 2 apart; now and then a blank one."""
    if dialect is SPARK:
        return f"""(SELECT document_id, page_number, CAST(line_index * 100 + word_index AS INT) AS item_ord, CASE WHEN word_index = 9 THEN ' ' ELSE word END AS str, 500.0 - 40.0 * word_index AS x, 800.0 - 14.0 * line_index + (word_index * 7 % 5) * 0.5 AS y, 6.0 * length(word) AS width, 10.0 AS height
            FROM (SELECT document_id, page_number, line_index, posexplode(split(line, ' ')) AS (word_index, word) FROM (SELECT document_id, page_number, posexplode(split(text, '\\n')) AS (line_index, line) FROM {report_pages_sql(dialect)} p) l) w)"""
    return f"""(SELECT document_id, page_number, CAST(line_index * 100 + word_index AS INT) AS item_ord, CASE WHEN word_index = 9 THEN ' ' ELSE word END AS str, 500.0::DOUBLE - 40.0 * word_index AS x, 800.0::DOUBLE - 14.0 * line_index + (word_index * 7 % 5) * 0.5 AS y, 6.0::DOUBLE * length(word) AS width, 10.0::DOUBLE AS height
            FROM (SELECT document_id, page_number, line_index, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS word_index FROM (SELECT document_id, page_number, line_index, string_split(line, ' ') AS words FROM (SELECT document_id, page_number, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_index FROM (SELECT document_id, page_number, string_split(text, chr(10)) AS lines FROM {report_pages_sql(dialect)} p) s) l) m) w)"""


def registered(spark: SparkSession, sf_dir: str) -> None:
    """The provided tables that the views are made of, as temporary views."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, sql, dealt: tuple[str, str] | None = None) -> DataFrame:
    """A view's rows in Spark; names are resolved at once, so later registrations don't change them.

    dealt: a table and its column that the view deals it by. It is dealt to as many tasks as the session asks for, however small the
    table is: where much is made of few bytes, the few partitions that adaptive execution would join them to leave cores idle.
    """
    registered(spark, sf_dir)
    if dealt:
        table, key = dealt
        spark.table(table).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).createOrReplaceTempView(table)
    return spark.sql(f"SELECT * FROM {sql(SPARK)} AS v")


def references_demo_sql(dialect: Dialect) -> str:
    """Orders as references to cells of cells_demo: one or two cells of a row, none for every seventh; some cells don't exist."""
    make = "array" if dialect is SPARK else "list_value"
    none = "CAST(array() AS ARRAY<INT>)" if dialect is SPARK else "CAST([] AS INT[])"
    return f"""(SELECT concat('O', CAST(k AS STRING)) AS document_id, 0 AS candidate_ord, CAST(k AS INT) AS row_pos, concat('label ', CAST(k AS STRING)) AS label, CAST(2020 + k % 3 AS STRING) AS column_key, CAST(k % 2 AS INT) + 1 AS page, CAST(k % 3 AS INT) AS row_index,
        CASE WHEN k % 7 = 0 THEN {none} WHEN k % 2 = 0 THEN {make}(CAST((k + 1) % 6 AS INT), CAST(k % 4 AS INT)) ELSE {make}(CAST(k % 4 AS INT)) END AS cell_indices FROM (SELECT o_orderkey AS k FROM orders) o)"""


def display_demo_sql(dialect: Dialect) -> str:
    """Orders as facts of an assembled document, with up to four values and labels."""
    make = "array" if dialect is SPARK else "list_value"
    none = "CAST(array() AS ARRAY<STRING>)" if dialect is SPARK else "CAST([] AS VARCHAR[])"
    shown = dialect.grouped("CAST(floor(o_totalprice) AS BIGINT)")
    year = "CAST(year(o_orderdate) AS STRING)"
    return f"""(SELECT concat(CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'separate' ELSE 'unknown' END, '_FY', {year}) AS context_ref, CASE o_orderkey % 3 WHEN 0 THEN '천원' WHEN 1 THEN 'KRW' ELSE 'USD' END AS unit_ref,
        CASE o_orderkey % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow_statement' ELSE 'equity_changes' END AS statement_type,
        CASE o_orderkey % 5 WHEN 0 THEN ' 자산총계' WHEN 1 THEN '매출  원가' WHEN 2 THEN '영업이익' ELSE concat('계정 ', CAST(o_orderkey % 50 AS STRING)) END AS label,
        CASE o_orderkey % 4 WHEN 3 THEN {make}({shown}, '-', concat('(', {shown}, ')'), '0', '12', 'n/a') WHEN 2 THEN {make}({shown}) WHEN 1 THEN {make}('-5', {shown}, '', '7') ELSE {make}({shown}, concat('(', {shown}, ')')) END AS all_values,
        CASE o_orderkey % 4 WHEN 3 THEN CASE WHEN o_orderstatus = 'F' THEN {make}('share_capital', 'capital_surplus', 'treasury_stock', 'retained_earnings', '기타', 'total_equity') ELSE {make}('당기', {year}) END WHEN 2 THEN {none} ELSE {make}(concat('FY', {year}), '') END AS column_labels,
        CASE WHEN o_orderkey % 8 = 2 THEN {make}('period') ELSE {none} END AS period_labels, CAST(o_orderkey % 700 AS INT) AS extraction_order, o_orderkey AS fact_ord, o_totalprice AS value FROM orders)"""


def runs_demo_sql(dialect: Dialect) -> str:
    """Orders as saved runs."""
    if dialect is SPARK:
        files = "array(named_struct('name', concat('f', CAST(o_custkey AS STRING), '.pdf'), 'size', o_custkey * 1000), named_struct('name', 'all.pdf', 'size', CAST(o_orderkey % 5 AS BIGINT)))"
        kinds = "array(o_orderstatus, 'annual_report')"
    else:
        files = "[{'name': concat('f', CAST(o_custkey AS STRING), '.pdf'), 'size': o_custkey * 1000}, {'name': 'all.pdf', 'size': CAST(o_orderkey % 5 AS BIGINT)}]"
        kinds = "[o_orderstatus, 'annual_report']"
    return f"""(SELECT concat('R', CAST(o_orderkey % 5000 AS STRING)) AS id, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('f', CAST(o_custkey AS STRING), '.pdf') END AS filename, {files} AS files, {kinds} AS report_types, o_orderkey % 7 AS n_candidates, o_orderkey % 100 AS n_facts, o_orderkey % 3 AS n_issues FROM orders)"""


def answers_demo_sql(dialect: Dialect) -> str:
    """Turns of conversations as what a model answered: plain JSON, fenced, among words, or broken."""
    nl = dialect.newline()
    body = "concat('{\"n\": ', CAST(conv_id AS STRING), ', \"role\": \"', role, '\"}')"
    return f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN {body} WHEN 1 THEN concat('```json', {nl}, {body}, {nl}, '```') WHEN 2 THEN concat('Here: ', {body}, ' - done.') WHEN 3 THEN concat('{{\"n\": ', CAST(conv_id AS STRING)) ELSE '   ' END AS response FROM conversations)"""


def segments_json_sql(dialect: Dialect) -> str:
    """A response with two segments for each customer: known and unknown types, pages out of range, null or missing."""
    return """(SELECT concat('C', CAST(k AS STRING)) AS document_id, concat('{"segments": [{"statement_type": "', CASE k % 5 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow_statement' WHEN 3 THEN 'equity_changes' ELSE 'notes' END, '", "scope": "', CASE k % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' ELSE 'group' END, '", "start_page": ', CAST(k % 30 - 3 AS STRING), ', "end_page": ', CASE k % 6 WHEN 0 THEN 'null' WHEN 1 THEN '2.5' ELSE CAST(k % 7 AS STRING) END, ', "confidence": 0.', CAST(k % 9 AS STRING), ', "reason": "r"}, {"statement_type": "balance_sheet", "start_page": 1, "end_page": 2, "confidence": null}', CASE WHEN k % 2 = 0 THEN ', {"statement_type": "balance_sheet", "start_page": 2, "end_page": 1}' ELSE ', {"statement_type": "equity_changes", "end_page": 1}' END, ']}') AS response FROM (SELECT DISTINCT o_custkey AS k FROM orders) c)"""


def vision_json_sql(dialect: Dialect) -> str:
    """A response with three rows for each order, read from page images."""
    shown = dialect.grouped("CAST(floor(o_totalprice) AS BIGINT)")
    return f"""(SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, CAST(o_orderkey AS INT) AS candidate_ord, concat('{{"unit": "', CASE o_orderkey % 4 WHEN 0 THEN 'thousand_KRW' WHEN 1 THEN '백만원' WHEN 2 THEN 'won' ELSE 'USD' END, '", "columns": [{{"key": "c1", "label": "당기"}}, {{"key": "c2"}}, {{"label": "x"}}], "rows": [{{"label": " 자산총계 ", "depth": 1, "values": {{"c1": "', {shown}, '", "c2": "-"}}}}, {{"label": "부채 기타", "values": {{"c1": "", "c2": "(', {shown}, ')"}}, "notes": ["3", ""]}}, {{"label": "", "values": {{"c1": "1"}}}}, {{"label": "빈 행", "values": {{"c1": "-"}}}}]}}') AS response FROM orders)"""


def structure_json_sql(dialect: Dialect) -> str:
    """A structure for each document of cells_demo: two good rows out of order, one with a cell that isn't there, one without a label."""
    return """(SELECT concat('O', CAST(k AS STRING)) AS document_id, 0 AS candidate_ord, concat('```json {"unit": "thousand", "columns": [', CASE WHEN k % 3 = 0 THEN '' ELSE '{"key": "2024", "label": "당기"}, {"key": "x"}, {"key": "2023", "label": ""}' END, '], "rows": [{"order": 2, "label": "Ⅰ. 자산  총계", "notes": ["4", " "], "value_cells": {"2024": {"page": 1, "row_index": 0, "cell_indices": [0]}, "2023": {"page": "1", "row_index": 0, "cell_indices": [1, 0]}}}, {"order": 1, "label": "부채 ', CAST(k AS STRING), '", "value_cells": {"2024": {"page": 2, "row_index": 0, "cell_indices": [0]}, "2023": {"page": 2, "row_index": 50, "cell_indices": [0]}}}, {"order": 3, "label": "", "value_cells": {"2024": {"page": 1, "row_index": 0, "cell_indices": [0]}}}, {"label": "없음", "value_cells": {"2023": {"page": 1, "row_index": 0, "cell_indices": []}}}]} ```') AS response FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) d)"""


def edits_demo_sql(dialect: Dialect) -> str:
    """What a reviewer changed of spans_demo: nothing of most, one or several values of others."""
    return """(SELECT concat('C', CAST(o_custkey AS STRING)) AS document_id, CAST(o_orderkey AS INT) AS candidate_ord, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 = 0 END AS include, CASE WHEN o_orderkey % 7 = 0 THEN 'consolidated' END AS scope,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(2 + o_orderkey % 6 AS INT) END AS start_page, CAST(NULL AS INT) AS end_page FROM orders WHERE o_totalprice > 100000)"""


def images_demo_sql(dialect: Dialect) -> str:
    """Parts as requests with two images, one with a size and one that is only encoded; every ninth has none."""
    if dialect is SPARK:
        return "(SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN array(named_struct('width', CAST(p_size * 40 AS DOUBLE), 'height', CAST(p_partkey % 1000 AS DOUBLE), 'base64', CAST(NULL AS STRING)), named_struct('width', CAST(NULL AS DOUBLE), 'height', CAST(NULL AS DOUBLE), 'base64', repeat(p_name, 1 + p_size))) END AS images FROM part)"
    return "(SELECT p_partkey, p_size, p_name FROM part)"
