"""Words of Korean financial reports that the operators look for.

Fixed values: results depend on these lists and on their order.
"""

from __future__ import annotations

STATEMENT_TYPES = ["balance_sheet", "income_statement", "cash_flow_statement", "equity_changes"]
SCOPES = ["consolidated", "separate", "unknown"]

#: The reason that a title hit gives.
TITLE_REASON = {
    "balance_sheet": "재무상태표",
    "income_statement": "손익계산서",
    "cash_flow_statement": "현금흐름표",
    "equity_changes": "자본변동표",
}

ROW_KEYWORDS = {
    "balance_sheet": ["자산", "자산총계", "부채", "부채총계", "자본", "자본총계", "assets", "liabilities", "equity"],
    "income_statement": ["매출액", "매출원가", "매출총이익", "영업이익", "당기순이익", "기타포괄손익", "총포괄손익", "포괄손익의귀속", "주당이익", "revenue", "sales", "gross profit", "operating income", "net income"],
    "cash_flow_statement": ["영업활동현금흐름", "영업활동으로인한현금흐름", "투자활동현금흐름", "투자활동으로인한현금흐름", "재무활동현금흐름", "재무활동으로인한현금흐름", "영업에서창출된현금", "이자수취", "이자지급", "법인세납부", "기말현금", "기초현금", "현금및현금성자산", "operating activities", "investing activities", "financing activities"],
    "equity_changes": ["자본금", "자본잉여금", "자본조정", "기타자본구성요소", "이익잉여금", "비지배지분", "기초자본", "기말자본", "자본총계", "배당금지급", "주식보상비용", "자기주식", "share capital", "retained earnings", "total equity"],
}

CASH_FLOW_TAIL = ["재무활동현금흐름", "재무활동으로인한현금흐름", "현금및현금성자산에대한환율변동효과", "현금및현금성자산의순증가", "현금및현금성자산의증가", "기초현금및현금성자산", "기말현금및현금성자산", "기초의현금", "기말의현금", "현금의증가", "현금의감소"]

REPORT_PATTERNS = {
    "annual_report": ["사업보고서", "반기보고서", "분기보고서", "annual report"],
    "audit_report": ["독립된감사인의감사보고서", "독립된감사인의검토보고서", "감사보고서", "independent auditor", "audit report"],
}

REQUIRED_SECTIONS = {
    "annual_report": ["회사의개요", "사업의내용", "재무에관한사항", "이사회", "주주", "임원", "계열회사", "상세표"],
    "audit_report": ["독립된감사인의감사보고서", "감사의견", "재무상태표", "포괄손익계산서", "손익계산서", "자본변동표", "현금흐름표", "주석"],
}

#: Section names that count only as a line of their own.
STANDALONE_TITLES = ["재무상태표", "포괄손익계산서", "손익계산서", "자본변동표", "현금흐름표"]

NOT_ACCOUNTS = ["자산", "부채", "자본", "구분", "계정과목", "과목"]
NOT_ACCOUNT_PARTS = ["재무상태표", "손익계산서", "포괄손익계산서", "자본변동표", "현금흐름표", "단위", "현재", "기간", "목차", "주석", "외부감사", "dart.fss.or.kr", "page"]

CASH_FLOW_START = ["영업활동현금흐름", "영업활동으로인한현금흐름", "cashflowsfromoperating"]
CASH_FLOW_END = ["기말현금및현금성자산", "기말의현금", "현금및현금성자산의기말잔액", "cashandcashequivalentsatend"]
NOTE_ROWS = ["재무제표주석", "연결재무제표주석", "회사의개요", "일반적사항", "재무제표작성기준", "중요한회계처리방침", "주주명", "소유주식수", "지분율", "전자공시시스템", "dart.fss.or.kr"]

CONCEPT_ALIASES = [
    ("현금및현금성자산", "CashAndCashEquivalents"),
    ("기말현금및현금성자산", "CashAndCashEquivalentsEnding"),
    ("기초현금및현금성자산", "CashAndCashEquivalentsBeginning"),
    ("매출채권및기타유동채권", "TradeAndOtherCurrentReceivables"),
    ("매출채권", "TradeReceivables"),
    ("재고자산", "Inventories"),
    ("유동재고자산", "Inventories"),
    ("당기법인세자산", "CurrentTaxAssets"),
    ("기타유동금융자산", "OtherCurrentFinancialAssets"),
    ("기타유동자산", "OtherCurrentAssets"),
    ("비유동자산", "NoncurrentAssets"),
    ("유동자산", "CurrentAssets"),
    ("유형자산", "PropertyPlantAndEquipment"),
    ("투자부동산", "InvestmentProperty"),
    ("무형자산", "IntangibleAssets"),
    ("사용권자산", "RightOfUseAssets"),
    ("순이연법인세자산", "DeferredTaxAssets"),
    ("이연법인세자산", "DeferredTaxAssets"),
    ("지분법적용투자지분", "InvestmentsAccountedForUsingEquityMethod"),
    ("자산총계", "Assets"),
    ("매입채무및기타유동채무", "TradeAndOtherCurrentPayables"),
    ("매입채무및기타채무", "TradeAndOtherPayables"),
    ("단기차입금및사채", "ShortTermBorrowingsAndBonds"),
    ("유동차입금", "CurrentBorrowings"),
    ("유동리스부채", "CurrentLeaseLiabilities"),
    ("유동성리스부채", "CurrentLeaseLiabilities"),
    ("유동충당부채", "CurrentProvisions"),
    ("기타유동금융부채", "OtherCurrentFinancialLiabilities"),
    ("기타유동부채", "OtherCurrentLiabilities"),
    ("당기법인세부채", "CurrentTaxLiabilities"),
    ("비유동부채", "NoncurrentLiabilities"),
    ("유동부채", "CurrentLiabilities"),
    ("장기차입금및사채", "LongTermBorrowingsAndBonds"),
    ("장기차입금", "LongTermBorrowings"),
    ("비유동리스부채", "NoncurrentLeaseLiabilities"),
    ("부채총계", "Liabilities"),
    ("자본금", "ShareCapital"),
    ("자본잉여금", "CapitalSurplus"),
    ("자본조정", "CapitalAdjustments"),
    ("자기주식", "TreasuryShares"),
    ("기타자본구성요소", "OtherComponentsOfEquity"),
    ("이익잉여금", "RetainedEarnings"),
    ("비지배지분", "NoncontrollingInterests"),
    ("자본총계", "Equity"),
    ("매출액", "Revenue"),
    ("매출원가", "CostOfRevenue"),
    ("매출총이익", "GrossProfit"),
    ("판매비와관리비", "SellingGeneralAdministrativeExpenses"),
    ("영업이익", "OperatingIncome"),
    ("금융수익", "FinanceIncome"),
    ("금융비용", "FinanceCosts"),
    ("법인세비용차감전순이익", "ProfitBeforeTax"),
    ("법인세비용", "IncomeTaxExpense"),
    ("당기순이익", "NetIncome"),
    ("총포괄손익", "ComprehensiveIncome"),
    ("영업활동현금흐름", "CashFlowFromOperatingActivities"),
    ("투자활동현금흐름", "CashFlowFromInvestingActivities"),
    ("재무활동현금흐름", "CashFlowFromFinancingActivities"),
    ("차입금", "Borrowings"),
    ("리스부채", "LeaseLiabilities"),
]

STATEMENT_LABELS = {"balance_sheet": "재무상태표", "income_statement": "손익계산서", "cash_flow_statement": "현금흐름표", "equity_changes": "자본변동표"}
SCOPE_LABELS = {"consolidated": "연결", "separate": "별도", "unknown": "일반"}
UNIT_CAPTIONS = {"KRW": "단위: 원", "천원": "단위: 천원", "백만원": "단위: 백만원", "억원": "단위: 억원"}

EQUITY_COLUMNS = ["자본금", "자본잉여금", "자본조정", "기타자본구성요소", "기타포괄손익누계액", "이익잉여금", "비지배지분", "자본총계", "총계"]
EQUITY_COLUMNS_BY_COUNT = {
    6: ["자본금", "자본잉여금", "자기주식", "기타자본구성요소", "이익잉여금", "자본 합계"],
    7: ["자본금", "자본잉여금", "자본조정", "기타자본구성요소", "이익잉여금", "비지배지분", "자본총계"],
    8: ["자본금", "자본잉여금", "자본조정", "기타자본구성요소", "이익잉여금", "지배기업 소유주지분", "비지배지분", "자본총계"],
}
EQUITY_COLUMN_NAMES = {
    "share_capital": "자본금",
    "capital_surplus": "자본잉여금",
    "capital_adjustments": "자본조정",
    "treasury_stock": "자기주식",
    "other_components_of_equity": "기타자본구성요소",
    "other_comprehensive_income": "기타포괄손익누계액",
    "retained_earnings": "이익잉여금",
    "owners_of_parent": "지배기업 소유주지분",
    "parent_equity": "지배기업 소유주지분",
    "noncontrolling_interests": "비지배지분",
    "total_equity": "자본총계",
}
TOTAL_ROWS = "총계|합계|총자산|부채총계|자본총계|기말|당기순이익|총포괄손익|영업이익|현금및현금성자산"
