"""DuckDB SQL for the report queries, written on its own: joins and groups where Spark folds arrays, and RE2 patterns without lookaround."""

from __future__ import annotations

from factloom.functions import vocabulary as W
from factloom.plans import views as V
from factloom.plans.views import DUCK

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NUM = r"\(?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?"
SQL: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def compact(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g'))"


def squeezed(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def hits(s: str, c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({s}, {q(w)}) OR contains({c}, {q(''.join(w.split()))}) THEN 1 ELSE 0 END)" for w in words) + ")"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def by_kind(make) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {make(k)}" for k in W.STATEMENT_TYPES) + " END"


def number(raw: str) -> str:
    """The number that a cell shows."""
    t = trimmed(f"coalesce({raw}, '')")
    d = f"regexp_replace({t}, '[^0-9.-]', '', 'g')"
    plain = f"CASE WHEN contains({d}, '.') THEN try_cast(nullif(regexp_extract({d}, '^-?(?:\\d+\\.?\\d*|\\.\\d+)'), '') AS DOUBLE) ELSE try_cast(nullif(regexp_extract({d}, '^-?\\d+'), '') AS DOUBLE) END"
    return f"(CASE WHEN {raw} IS NULL OR {t} = '-' THEN NULL ELSE (CASE WHEN starts_with({t}, '(') AND ends_with({t}, ')') THEN -1 ELSE 1 END) * ({plain}) + 0.0::DOUBLE END)"


def factor(unit: str) -> str:
    return f"(CASE {unit} WHEN 'KRW' THEN 1 WHEN '원' THEN 1 WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 WHEN '억원' THEN 100000000 END)"


def unit_label(u: str) -> str:
    t = trimmed(f"coalesce({u}, 'KRW')")
    return f"(CASE WHEN regexp_matches({t}, '(?i)thousand|천{WS}*원') THEN '천원' WHEN regexp_matches({t}, '(?i)million|백{WS}*만{WS}*원') THEN '백만원' WHEN regexp_matches({t}, '억{WS}*원') THEN '억원' WHEN regexp_matches({t}, '(?i)won|원|krw') THEN 'KRW' WHEN {t} = '' THEN 'KRW' ELSE {t} END)"


def concept(label: str) -> str:
    """Ranked by alias length through a list instead of a chain of cases."""
    key = f"lower(regexp_replace({label}, '(?:{WS}|[(){{}}\\[\\]·ㆍ,.-])+', '', 'g'))"
    aliases = "[" + ", ".join(f"{{'a': {q(a)}, 'c': {q(c)}, 'n': {len(a) * 1000 - i}}}" for i, (a, c) in enumerate(W.CONCEPT_ALIASES)) + "]"
    return f"coalesce(list_sort(list_transform(list_filter({aliases}, lambda x: contains({key}, x.a)), lambda x: {{'n': -x.n, 'c': x.c}}))[1].c, nullif(left({key}, 80), ''), 'UnknownConcept')"


# ---- shared steps -----------------------------------------------------------------------------------------------------------

PREFIX = r"^\d+(?:-\d+)?\."
TITLE = f"""CASE WHEN length(c) BETWEEN 1 AND 50 AND NOT {any_of('c', ['주석', '인식', '관련'])} AND (NOT regexp_matches(c, '{PREFIX}') OR regexp_matches(c, '^0*[1-4](?:-0*[1-4])?\\.')) THEN
    CASE WHEN regexp_matches(p, '^(?:연결|개별|별도)?(?:포괄)?손익계산서$') THEN 'income_statement' WHEN regexp_matches(p, '^(?:연결|개별|별도)?(?:포괄)?재무상태표$') THEN 'balance_sheet'
        WHEN regexp_matches(p, '^(?:연결|개별|별도)?(?:포괄)?현금흐름표$') THEN 'cash_flow_statement' WHEN regexp_matches(p, '^(?:연결|개별|별도)?자본변동표$') THEN 'equity_changes' END END"""
PAGES = f"pages AS (SELECT document_id, page_number, text, string_split_regex(text, '\\n+') AS ls FROM {V.report_pages_sql(DUCK)} v)"
LINES = f"{PAGES}, lines AS (SELECT document_id, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS idx FROM pages)"
TITLES = f"{LINES}, titles AS (SELECT * FROM (SELECT document_id, page_number, idx, {TITLE} AS kind, regexp_matches(c, '{PREFIX}') AS prefixed FROM (SELECT *, regexp_replace(c, '{PREFIX}', '') AS p FROM (SELECT *, {compact('line')} AS c FROM lines) a) b) t WHERE kind IS NOT NULL)"


def slices(pages: str, titles: str, name: str) -> str:
    """name(document_id, page_number, kind, segment, titled) of pages(…, ls) and titles(…, idx, kind, prefixed), for all four kinds."""
    kinds = ", ".join(f"('{k}')" for k in W.STATEMENT_TYPES)
    return f"""{name}_start AS (SELECT p.document_id, p.page_number, k.kind, coalesce(min(t.idx) FILTER (t.kind = k.kind AND NOT t.prefixed), max(t.idx) FILTER (t.kind = k.kind)) AS start FROM {pages} p CROSS JOIN (VALUES {kinds}) k(kind) LEFT JOIN {titles} t USING (document_id, page_number) GROUP BY ALL),
    {name}_stop AS (SELECT s.document_id, s.page_number, s.kind, s.start, min(t.idx) FILTER (NOT t.prefixed AND t.idx > coalesce(s.start, -1)) AS stop FROM {name}_start s LEFT JOIN {titles} t USING (document_id, page_number) GROUP BY ALL),
    {name} AS (SELECT document_id, page_number, kind, start IS NOT NULL AS titled, CASE WHEN start IS NULL AND stop IS NULL THEN text ELSE array_to_string(ls[coalesce(start, 0) + 1 : coalesce(stop, len(ls))], chr(10)) END AS segment FROM {name}_stop JOIN {pages} USING (document_id, page_number))"""


#: A comma number becomes 9N9, so that a zero beside it stays beside a digit; single zeros are digit runs that equal 0.
def valued(x: str) -> str:
    marked = "regexp_replace(l, '(\\(?)\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?(\\)?)', '\\19N9\\2', 'g')"
    return f"len(list_filter(string_split_regex({x}, '\\n+'), lambda l: len(regexp_extract_all({marked}, 'N|-')) + len(list_filter(regexp_extract_all({marked}, '\\d+'), lambda z: z = '0')) >= 2))"


def evidenced(segments: str, name: str) -> str:
    s, c = squeezed("segment"), compact("segment")
    return f"""{name} AS (SELECT *, {by_kind(lambda k: hits('s', 'c', W.ROW_KEYWORDS[k]))} AS n_rows, {count('s', NUM)} AS n_numbers, {valued('segment')} AS n_valued, contains(s, '목차') OR contains(s, 'table of contents') OR {count('s', '[.][.][.]')} > 20 AS toc FROM (SELECT *, {s} AS s, {c} AS c FROM {segments}) x)"""


SEGMENTS = f"{TITLES}, {slices('pages', 'titles', 'seg')}, {evidenced('seg', 'ev')}"
HEAD = f"list_filter(list_transform(string_split_regex(text, '\\n+'), lambda l: {trimmed('l')}), lambda l: l <> '')[1:6]"
PAGE_FLAGS = f"""flags AS (SELECT document_id, page_number, regexp_matches(s, '^\\d+(?:-\\d+)?\\. *(?:연결 *)?재무제표 *주석') OR regexp_matches(s, '^(?:연결 *)?재무제표 *주석') OR starts_with(c, '주석') OR starts_with(c, '재무제표주석') OR starts_with(c, '연결재무제표주석') OR starts_with(c, '외부감사실시내용') AS other_section,
    {hits('ts', 'tc', W.CASH_FLOW_TAIL)} >= 2 AND {count('ts', NUM)} >= 4 AS tail
    FROM (SELECT document_id, page_number, {squeezed("array_to_string(h, ' ')")} AS s, {compact("array_to_string(h, '')")} AS c, {squeezed('text')} AS ts, {compact('text')} AS tc FROM (SELECT *, {HEAD} AS h FROM pages) a) b)"""
POINTS = "CASE WHEN n_rows >= 1 AND n_numbers >= 6 THEN greatest(50 + least(40, 8 * n_rows) + least(30, n_numbers) - CASE WHEN toc THEN 180 ELSE 0 END, 0) ELSE 0 END"
GOES_ON = f"({trimmed('segment')} <> '' AND ((n_rows >= 1 AND n_numbers >= 2) OR n_valued >= 2))"
FORWARD = f"""fpages AS (SELECT p.document_id, p.page_number, string_agg(n.text, chr(10) ORDER BY n.page_number) AS text FROM pages p JOIN pages n ON n.document_id = p.document_id AND n.page_number BETWEEN p.page_number AND p.page_number + 3 GROUP BY ALL),
    fcut AS (SELECT *, string_split_regex(text, '\\n+') AS ls FROM fpages),
    ftitles AS (SELECT * FROM (SELECT document_id, page_number, idx, {TITLE} AS kind, regexp_matches(c, '{PREFIX}') AS prefixed FROM (SELECT *, regexp_replace(c, '{PREFIX}', '') AS p FROM (SELECT *, {compact('line')} AS c FROM (SELECT document_id, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS idx FROM fcut) l) a) b) t WHERE kind IS NOT NULL),
    {slices('fcut', 'ftitles', 'fseg')}, {evidenced('fseg', 'fev')}"""
SCORED = f"""{SEGMENTS}, {FORWARD}, scored AS (SELECT * FROM (SELECT e.document_id, e.page_number, e.kind, e.n_rows AS own_rows, e.n_numbers AS own_numbers, e.n_valued AS own_valued, CASE WHEN e.p > 0 THEN e.p ELSE f.p END AS score, CASE WHEN e.p > 0 THEN e.n_rows ELSE f.n_rows END AS n_rows, CASE WHEN e.p > 0 THEN e.n_numbers ELSE f.n_numbers END AS n_numbers, CASE WHEN e.p > 0 THEN e.toc ELSE f.toc END AS toc
    FROM (SELECT *, {POINTS} AS p FROM ev WHERE titled) e JOIN (SELECT *, {POINTS} AS p FROM fev) f USING (document_id, page_number, kind)) x WHERE score > 0)"""


def last_at(s: str, pattern: str) -> str:
    """Where the last match begins: what follows it is the last part of the text cut at all matches."""
    return f"CASE WHEN regexp_matches({s}, '{pattern}') THEN length({s}) - length(string_split_regex({s}, '{pattern}')[-1]) - length(regexp_extract_all({s}, '{pattern}')[-1]) END"


_HEADINGS = [("s", r"\d+(?:-\d+)?\. *연결 *재무제표", "consolidated"), ("s", "연결 *재무제표 *주석", "consolidated"), ("s", r"\d+(?:-\d+)?\. *(?:개별|별도) *재무제표", "separate"), ("noted", r"\d+\. *재무제표", "separate"), ("s", "(?:개별|별도) *재무제표 *주석", "separate")]
_PLACES = ", ".join(f"{{'at': {last_at(s, p)}, 'o': {-i}, 'scope': '{scope}'}}" for i, (s, p, scope) in enumerate(_HEADINGS))
_NAMES = "(?:포괄재무상태표|재무상태표|포괄손익계산서|손익계산서|자본변동표|포괄현금흐름표|현금흐름표)"
SCOPES = f"""detected AS (SELECT document_id, page_number, s, list_sort(list_filter([{_PLACES}], lambda x: x.at IS NOT NULL))[-1].scope AS detected_scope FROM (SELECT *, regexp_replace(s, '재무제표( *주석)', '재무제@\\1', 'g') AS noted FROM (SELECT *, {squeezed('text')} AS s FROM pages) a) b),
    context AS (SELECT *, last_value(detected_scope IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS context_scope FROM detected),
    scopes AS (SELECT document_id, page_number, detected_scope, context_scope, CASE WHEN regexp_matches(s, '연결 *{_NAMES}') THEN 'consolidated' WHEN regexp_matches(s, '(?:개별|별도) *{_NAMES}') THEN 'separate' ELSE coalesce(detected_scope, context_scope, CASE WHEN contains(s, 'consolidated') THEN 'consolidated' ELSE 'unknown' END) END AS scope FROM context)"""
REASON = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.TITLE_REASON.items()) + " END"
TYPE_ORD = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(W.STATEMENT_TYPES)) + " END"
SPANS = f"""{SCORED}, {PAGE_FLAGS}, {SCOPES}, last_pages AS (SELECT document_id, max(page_number) AS last_page FROM pages GROUP BY 1), titled AS (SELECT DISTINCT document_id, page_number FROM titles),
    signals AS (SELECT e.document_id, e.page_number, e.kind, t.page_number IS NOT NULL AS titled, {GOES_ON} AS goes_on, other_section, tail FROM ev e JOIN flags USING (document_id, page_number) LEFT JOIN titled t USING (document_id, page_number)),
    starts AS (SELECT s.document_id, s.page_number, s.kind, s.score, s.n_rows, s.n_numbers, s.toc, CASE WHEN own_rows >= 1 AND own_numbers >= 6 AND own_valued >= 2 THEN s.page_number ELSE coalesce((SELECT arg_min(CASE WHEN g.titled THEN s.page_number ELSE g.page_number END, g.page_number) FROM signals g WHERE g.document_id = s.document_id AND g.kind = s.kind AND g.page_number BETWEEN s.page_number + 1 AND s.page_number + 3 AND (g.titled OR g.goes_on)), s.page_number) END AS start_page FROM scored s),
    ends AS (SELECT s.*, least(last_page, start_page + 3) AS most, (SELECT arg_min(CASE WHEN (g.other_section AND g.tail AND g.kind = 'cash_flow_statement') OR (NOT g.other_section AND g.goes_on) THEN g.page_number ELSE greatest(s.start_page, g.page_number - 1) END, g.page_number) FROM signals g WHERE g.document_id = s.document_id AND g.kind = s.kind AND g.page_number BETWEEN s.start_page + 1 AND s.start_page + 3 AND (g.titled OR g.other_section)) AS stop FROM starts s JOIN last_pages USING (document_id)),
    found AS (SELECT document_id, page_number, kind, scope, score, start_page, coalesce(stop, most) AS end_page, {REASON} || ',statement_rows:' || n_rows || ',numeric_table:' || n_numbers || CASE WHEN toc THEN ',toc_penalty' ELSE '' END AS reasons, {TYPE_ORD} AS type_ord FROM ends JOIN scopes USING (document_id, page_number)),
    firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY document_id, scope, kind, start_page, end_page ORDER BY page_number, type_ord) = 1),
    candidates AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start_page, score DESC, page_number, type_ord) - 1 AS INT) AS candidate_ord, true AS include, scope, kind AS statement_type, start_page, end_page, score, reasons FROM firsts)"""

# ---- rows of statements -----------------------------------------------------------------------------------------------------

_VALUE = rf"^(?:-|0|{NUM})$"


def metrics(segments: str, name: str) -> str:
    """name(…, line_index, label, value, all_values, unit, scale, period, period_labels) of segments(document_id, candidate_ord, page_number, kind, segment)."""
    c = f"lower(regexp_replace(segment, '{WS}+', '', 'g'))"
    unit = f"CASE WHEN contains({c}, '단위:천원') OR contains({c}, '단위：천원') THEN '천원' WHEN contains({c}, '단위:백만원') THEN '백만원' WHEN contains({c}, '단위:억원') THEN '억원' ELSE 'KRW' END"
    day = f"nullif(regexp_extract(segment, '(20\\d{{2}})[.\\-/]{WS}*0?12[.\\-/]{WS}*0?31', 1), '')"
    year = f"nullif(regexp_extract(segment, '(?s)20\\d{{2}}[.\\-/]{WS}*01[.\\-/]{WS}*01.*?(20\\d{{2}})[.\\-/]{WS}*12[.\\-/]{WS}*31', 1), '')"
    term = f"nullif(regexp_replace(regexp_extract(segment, '제{WS}*\\d+(?:\\([^)]+\\))?{WS}*기'), '{WS}+', '', 'g'), '')"
    label = "array_to_string(tokens[1:len(tokens) - n], ' ')"
    for pattern in (rf"^(?:{WS}|[:·ㆍ-])+", rf"(?:{WS}|[:·ㆍ-])+$", rf"(?i)^[IVXLCDMⅠ-ⅿ]+(?:{WS}|[.)])+", rf"^[①-⑳❶-❿]{WS}*", rf"^\d+[.)]{WS}*", rf"{WS}+\d+(?:{WS}*,{WS}*\d+)*$", f"^{WS}+", f"{WS}+$"):
        label = f"regexp_replace({label}, {q(pattern)}, '')"
    bans = any_of("lower(lc)", W.NOT_ACCOUNT_PARTS)
    exact = "lc IN (" + ", ".join(map(q, W.NOT_ACCOUNTS)) + ")"
    return f"""{name}_lines AS (SELECT document_id, candidate_ord, page_number, kind, {unit} AS unit, coalesce(CASE WHEN kind = 'balance_sheet' THEN {day} || '.12.31' END, 'FY' || {year}, {term}, '') AS period, list_reverse_sort(list_distinct(regexp_extract_all(segment, '20\\d{{2}}')))[1:6] AS years, unnest(ls) AS raw_line, generate_subscripts(ls, 1) - 1 AS line_index FROM (SELECT *, string_split_regex(segment, '\\n+') AS ls FROM {segments}) a),
    {name}_tokens AS (SELECT *, list_filter(string_split_regex(raw_line, '{WS}+'), lambda t: t <> '') AS tokens FROM {name}_lines),
    {name}_counted AS (SELECT *, coalesce(list_position(list_transform(list_reverse(tokens), lambda t: NOT regexp_matches(t, '{_VALUE}')), true) - 1, len(tokens)) AS n FROM {name}_tokens),
    {name}_rows AS (SELECT *, {label} AS label, tokens[len(tokens) - n + 1:][1:3] AS vals FROM {name}_counted WHERE len(tokens) >= 2 AND n > 0),
    {name} AS (SELECT *, vals[1] AS value, array_to_string(vals, '|') AS all_values, CASE unit WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 WHEN '억원' THEN 100000000 ELSE 1 END AS scale, array_to_string(years[1:len(vals)], '|') AS period_labels
        FROM (SELECT *, regexp_replace(label, '{WS}+', '', 'g') AS lc FROM {name}_rows) x WHERE label <> '' AND length(lc) BETWEEN 2 AND 80 AND NOT ({exact} OR {bans} OR contains(lc, '전자공시시스템') OR regexp_matches(lc, '^제\\d+(?:\\([^)]+\\))?기') OR regexp_matches(lc, '^20\\d{{2}}[.\\-/]')) AND NOT contains(lower(label), 'dart.fss.or.kr') AND NOT regexp_matches(label, '{NUM}') AND regexp_matches(label, '[가-힣a-zA-Z]')
        QUALIFY row_number() OVER (PARTITION BY document_id, candidate_ord, page_number, label, vals[1] ORDER BY line_index) = 1)"""


LABEL_KEY = f"""regexp_replace(lower(coalesce(label, '')), '(?:{WS}|[(){{}}\\[\\]"''‘’“”,.·ㆍ:;/-])+', '', 'g')"""


def cash_flow(rows: str, name: str, kind: str = "statement_type") -> str:
    """name: rows(document_id, candidate_ord, row_ord, kind, label) as the fact filter leaves them."""
    return f"""{name}_key AS (SELECT *, {LABEL_KEY} AS key FROM {rows}),
    {name}_mark AS (SELECT *, key = '' OR {any_of('key', W.NOTE_ROWS)} AS note, coalesce(min(CASE WHEN {any_of('key', W.CASH_FLOW_START)} THEN row_ord END) OVER c, min(row_ord) OVER c) AS first FROM {name}_key WINDOW c AS (PARTITION BY document_id, candidate_ord)),
    {name}_end AS (SELECT *, coalesce(min(CASE WHEN {any_of('key', W.CASH_FLOW_END)} AND NOT note AND row_ord >= first THEN row_ord END) OVER c, max(row_ord) OVER c) AS last FROM {name}_mark WINDOW c AS (PARTITION BY document_id, candidate_ord)),
    {name} AS (SELECT * FROM {name}_end WHERE {kind} <> 'cash_flow_statement' OR (NOT note AND row_ord BETWEEN first AND last))"""


FACTS = f"""{SPANS}, taken AS (SELECT c.document_id, c.candidate_ord, c.scope, c.statement_type AS kind, p.page_number, s.segment FROM candidates c JOIN pages p ON p.document_id = c.document_id AND p.page_number BETWEEN c.start_page AND c.end_page JOIN seg s ON s.document_id = p.document_id AND s.page_number = p.page_number AND s.kind = c.statement_type),
    {metrics('taken', 'm')}, mrows AS (SELECT m.*, m.kind AS statement_type, row_number() OVER (PARTITION BY document_id, candidate_ord ORDER BY page_number, line_index) - 1 AS row_ord FROM m),
    {cash_flow('mrows', 'cf')}, kept AS (SELECT document_id, candidate_ord, coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY candidate_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT document_id, candidate_ord, count(*) AS n FROM cf GROUP BY ALL) k),
    facts AS (SELECT cf.document_id, d.filename, d.doc_ord, c.scope, cf.statement_type, {concept('cf.label')} AS concept, cf.label, cf.period, {number('cf.value')} * coalesce({factor('cf.unit')}, cf.scale) AS value, cf.unit, cf.page_number, cf.raw_line, cf.all_values, CAST(cf.row_ord + start AS INT) AS extraction_order, cf.candidate_ord, cf.row_ord FROM cf JOIN candidates c USING (document_id, candidate_ord) JOIN kept USING (document_id, candidate_ord) JOIN {V.report_documents_sql(DUCK)} d ON d.document_id = cf.document_id)"""

# ---- review -----------------------------------------------------------------------------------------------------------------

REFS = f"len(list_filter(ls, lambda l: regexp_matches({trimmed('l')}, '\\d{{1,4}}$') AND length({trimmed('l')}) > 3))"
TOC = f"""{PAGES}, docs AS (SELECT * FROM {V.report_documents_sql(DUCK)} d), ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS nth, {REFS} AS refs FROM pages),
    best AS (SELECT document_id, page_number AS toc_page, score FROM (SELECT *, CASE WHEN contains({compact('text')}, '목차') OR contains({compact('text')}, 'contents') THEN 50 ELSE 0 END + least(50, 5 * refs) AS score FROM ranked WHERE nth <= 20) s QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, nth) = 1),
    near AS (SELECT r.*, toc_page FROM ranked r JOIN best USING (document_id) JOIN docs USING (document_id) WHERE score >= 20 AND page_number BETWEEN toc_page AND least(page_count, toc_page + 2)),
    toc AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.document_id = n.document_id AND b.page_number <> b.toc_page AND b.refs < 3 AND b.page_number <= n.page_number))"""
_TITLE = "regexp_extract(line, '(?s)^(.{2,100}?)(?:\\.{2,}|\\s{2,}|\\s)\\s*(\\d{1,4})$', 1)"
for _pattern in (rf"(?i)^[IVXLCDMⅠ-ⅿ\d]+(?:{WS}|[.)-])*", rf"^[①-⑳❶-❿]{WS}*", rf"(?:{WS}|[-–—.])+$", f"^{WS}+"):
    _TITLE = f"regexp_replace({_TITLE}, {q(_pattern)}, '')"
ENTRIES = f"""{TOC}, toc_lines AS (SELECT *, {trimmed(f"regexp_replace(raw, '{WS}+', ' ', 'g')")} AS line FROM (SELECT document_id, page_number, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS idx FROM toc) l),
    parsed AS (SELECT document_id, page_number, idx, {_TITLE} AS title, CAST(regexp_extract(line, '(\\d{{1,4}})$', 1) AS INT) AS expected_page FROM toc_lines WHERE line <> '' AND {compact('line')} <> '목차' AND regexp_matches(line, '(?s)^(.{{2,100}}?)(?:\\.{{2,}}|\\s{{2,}}|\\s)\\s*(\\d{{1,4}})$')),
    unique_entries AS (SELECT *, {compact('title')} AS title_key FROM parsed WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY document_id, {compact('title')}, expected_page ORDER BY page_number, idx) = 1),
    entries AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, idx) - 1 AS INT) AS entry_ord FROM unique_entries) e WHERE entry_ord < 120),
    places AS (SELECT document_id, page_number, {compact('text')} AS compact_text, list_filter(list_transform(ls, lambda l: regexp_replace({compact('l')}, '{PREFIX}', '')), lambda x: NOT contains(x, '주석') AND length(x) BETWEEN 1 AND 40) AS own_lines FROM pages p WHERE NOT EXISTS (SELECT 1 FROM toc t WHERE t.document_id = p.document_id AND t.page_number = p.page_number))"""


def is_on(needle: str) -> str:
    names = ", ".join(map(q, W.STANDALONE_TITLES))
    return f"(CASE WHEN {needle} IN ({names}) THEN list_has_any(own_lines, [{needle}, '연결' || {needle}, '개별' || {needle}, '별도' || {needle}, '포괄' || {needle}, '연결포괄' || {needle}]) ELSE contains(compact_text, {needle}) END)"


CHECKS = f"""{ENTRIES}, worded AS (SELECT *, list_filter(string_split_regex(title_key, '[.()/\\-\\d]+'), lambda t: length(t) >= 2)[1:4] AS words FROM entries),
    tests AS (SELECT w.document_id, entry_ord, p.page_number, CASE WHEN {is_on('title_key')} THEN CASE WHEN abs(p.page_number - expected_page) <= 5 THEN 0 ELSE 1 END WHEN len(words) > 0 AND {is_on("array_to_string(words, '')")} AND len(list_filter(words, lambda x: NOT contains(compact_text, x))) = 0 THEN 2 END AS tier, p.page_number - expected_page AS off FROM worded w JOIN places p ON p.document_id = w.document_id),
    placed AS (SELECT document_id, entry_ord, page_number AS found_page FROM tests WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, entry_ord ORDER BY tier, CASE WHEN tier = 0 THEN abs(off) END, CASE WHEN tier = 0 THEN -off END, page_number) = 1),
    checks AS (SELECT document_id, entry_ord, title, expected_page, found_page, CASE WHEN found_page IS NULL THEN 'missing' WHEN found_page = expected_page THEN 'matched' WHEN abs(found_page - expected_page) <= 2 THEN 'near' ELSE 'page_mismatch' END AS status FROM entries LEFT JOIN placed USING (document_id, entry_ord))"""
_FOUND = {k: "list_filter([" + ", ".join(map(q, ws)) + "], lambda w: contains(head, replace(w, ' ', '')))" for k, ws in W.REPORT_PATTERNS.items()}
TYPES = f"""types AS (SELECT document_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 'unknown' WHEN len(a) >= len(b) THEN 'annual_report' ELSE 'audit_report' END AS report_type, CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE round(least(0.95, 0.45 + 0.2 * greatest(len(a), len(b))), 4) END AS confidence, array_to_string(CASE WHEN len(a) >= len(b) THEN a ELSE b END, '|') AS type_reasons
    FROM (SELECT document_id, {_FOUND['annual_report']} AS a, {_FOUND['audit_report']} AS b FROM (SELECT document_id, {compact("string_agg(text, chr(10) ORDER BY page_number)")} AS head FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_number) <= 12) f GROUP BY 1) h) x)"""
_SECTIONS = ", ".join(f"('{k}', {i}, {q(s)})" for k, names in W.REQUIRED_SECTIONS.items() for i, s in enumerate(names))
SECTIONS = f"""{CHECKS}, {TYPES}, wanted AS (SELECT document_id, section_ord, section FROM types JOIN (VALUES {_SECTIONS}) s(report_type, section_ord, section) USING (report_type)),
    sections AS (SELECT w.document_id, w.section_ord, w.section, min(p.page_number) AS found_page FROM wanted w LEFT JOIN places p ON p.document_id = w.document_id AND {is_on('w.section')} GROUP BY ALL)"""
ISSUES = f"""{SECTIONS}, issues AS (SELECT document_id, 0 AS step, 0 AS ord, 'high' AS severity, 'Document type could not be identified as audit report or annual report.' AS message FROM types WHERE report_type = 'unknown'
    UNION ALL SELECT document_id, 1, 0, 'medium', 'No table of contents was detected in the first 20 pages.' FROM types WHERE document_id NOT IN (SELECT document_id FROM toc)
    UNION ALL SELECT document_id, 1, 0, 'medium', 'A table of contents page was detected, but structured entries could not be parsed.' FROM types WHERE document_id IN (SELECT document_id FROM toc) AND document_id NOT IN (SELECT document_id FROM entries)
    UNION ALL SELECT document_id, 2, section_ord, 'medium', 'Expected section not found: ' || section FROM sections WHERE found_page IS NULL
    UNION ALL SELECT document_id, 3, entry_ord, 'low', 'TOC entry check failed: ' || title FROM (SELECT * FROM checks WHERE status IN ('missing', 'page_mismatch') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY entry_ord) <= 20) f)"""

# ---- display ----------------------------------------------------------------------------------------------------------------

DISPLAY = f"""rows AS (SELECT *, split_part(context_ref, '_', 1) AS scope FROM {V.display_demo_sql(DUCK)} v QUALIFY row_number() OVER (PARTITION BY context_ref, statement_type, label, extraction_order ORDER BY fact_ord) = 1),
    grouped AS (SELECT scope, statement_type, arg_min(unit_ref, (extraction_order, fact_ord)) AS unit, count(*) AS n_rows, max(len(all_values)) AS most FROM rows GROUP BY ALL),
    groups AS (SELECT *, CAST(CASE WHEN most < 1 THEN 1 WHEN statement_type = 'equity_changes' THEN most ELSE least(3, most) END AS INT) AS column_count FROM grouped)"""
_SUSPECT = "(x = '' OR regexp_matches(x, '^20\\d{2}$') OR x IN ('구분', '과목') OR " + any_of("x", ["당기", "전기", "current", "prior", "period", "column"]) + ")"
_ALIASED = "CASE t " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in W.EQUITY_COLUMN_NAMES.items()) + " ELSE t END"
_TEMPLATES = "CASE column_count " + " ".join(f"WHEN {n} THEN [{', '.join(map(q, names))}]" for n, names in W.EQUITY_COLUMNS_BY_COUNT.items()) + f" ELSE [{', '.join(map(q, W.EQUITY_COLUMNS))}] END"
COLUMNS = f"""{DISPLAY}, raw AS (SELECT scope, statement_type, extraction_order, fact_ord, unnest(src) AS raw, generate_subscripts(src, 1) AS pos FROM (SELECT *, CASE WHEN len(column_labels) > 0 THEN column_labels ELSE period_labels END AS src FROM rows) s),
    named AS (SELECT *, CASE WHEN statement_type = 'equity_changes' THEN {_ALIASED} ELSE t END AS column_label FROM (SELECT *, {trimmed('raw')} AS t FROM raw) x),
    seen AS (SELECT scope, statement_type, column_label, row_number() OVER (PARTITION BY scope, statement_type ORDER BY seen) AS nth FROM (SELECT scope, statement_type, column_label, min((extraction_order, fact_ord, pos)) AS seen FROM named WHERE column_label <> '' GROUP BY ALL) s),
    lists AS (SELECT g.scope, g.statement_type, g.column_count, coalesce(list(s.column_label ORDER BY s.nth) FILTER (s.column_label IS NOT NULL), []) AS labels FROM groups g LEFT JOIN seen s ON s.scope = g.scope AND s.statement_type = g.statement_type AND s.nth <= g.column_count GROUP BY ALL),
    chosen AS (SELECT scope, statement_type, column_count, CASE WHEN len(labels) >= column_count AND (statement_type <> 'equity_changes' OR len(list_filter(list_transform(labels, lambda l: lower(regexp_replace(l, '{WS}+', '', 'g'))), lambda x: {_SUSPECT})) = 0) THEN labels
        WHEN statement_type = 'equity_changes' THEN list_transform(range(1, column_count + 1), lambda n: coalesce(({_TEMPLATES})[n], 'Column ' || n)) ELSE list_transform(range(1, column_count + 1), lambda n: CASE n WHEN 1 THEN '최근 연도' WHEN 2 THEN '직전 연도' ELSE n || '번째 연도' END) END AS labels FROM lists),
    columns AS (SELECT scope, statement_type, unnest(labels) AS column_label, generate_subscripts(labels, 1) - 1 AS column_index FROM chosen)"""


def shown(x: str) -> str:
    t = trimmed(f"coalesce({x}, '')")
    d = f"regexp_replace({t}, '[^0-9.-]', '', 'g')"
    n = f"CASE WHEN {d} = '' THEN 0 ELSE try_cast({d} AS DOUBLE) END"
    digits = f"format('{{:,}}', CAST(abs({n}) AS BIGINT))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN {t} = '-' THEN '-' WHEN ({n}) IS NULL THEN {t} WHEN (starts_with({t}, '(') AND ends_with({t}, ')')) OR ({n}) < 0 THEN '(' || {digits} || ')' ELSE {digits} END"


_LABEL = trimmed(f"regexp_replace(label, '{WS}+', ' ', 'g')")
_NAME = {"scope": "CASE scope " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.SCOPE_LABELS.items()) + " END", "kind": "CASE statement_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.STATEMENT_LABELS.items()) + " END"}

# ---- positioned items -------------------------------------------------------------------------------------------------------

#: First fit as a recursive walk over the items of a page: the row of the nearest earlier anchor, lowest row first.
CELLS = f"""items AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY item_ord) AS nth FROM {V.items_demo_sql(DUCK)} v WHERE trim(str) <> ''),
    packed AS (SELECT document_id, page_number, list({{'o': item_ord, 'x': x, 'y': y, 'w': width, 'h': height, 't': str}} ORDER BY item_ord) AS its FROM items GROUP BY ALL),
    fitted AS (SELECT document_id, page_number, its, list_reduce(list_transform(its, lambda i: {{'anchors': [i.y], 'rows': [0]}}), lambda s, e: CASE WHEN len(list_filter(s.anchors, lambda a: abs(a - e.anchors[1]) < 3)) > 0
        THEN {{'anchors': s.anchors, 'rows': list_append(s.rows, CAST(list_position(list_transform(s.anchors, lambda a: abs(a - e.anchors[1]) < 3), true) - 1 AS INT))}} ELSE {{'anchors': list_append(s.anchors, e.anchors[1]), 'rows': list_append(s.rows, CAST(len(s.anchors) AS INT))}} END) AS fit FROM packed),
    flat AS (SELECT document_id, page_number, unnest(its) AS i, unnest(fit.rows) AS r, fit.anchors AS anchors FROM fitted),
    cells AS (SELECT document_id, page_number, CAST(dense_rank() OVER (PARTITION BY document_id, page_number ORDER BY anchors[r + 1] DESC, r) - 1 AS INT) AS row_index, CAST(row_number() OVER (PARTITION BY document_id, page_number, r ORDER BY i.x, i.o) - 1 AS INT) AS cell_index, anchors[r + 1] AS row_y, i.x AS x, i.y AS y, i.w AS width, i.t AS text FROM flat)"""
_NUMERIC = f"(text = '-' OR regexp_matches(text, '^\\(?\\d+(?:\\.\\d+)?\\)?$') OR regexp_matches(text, '^{NUM}$'))"
_PERIOD = "CASE WHEN regexp_matches(c, '20\\d{2}') THEN regexp_extract(c, '20\\d{2}') WHEN contains(c, '전전기') THEN 'prior_2' WHEN contains(c, '전기') OR regexp_matches(c, '제\\d+\\(?전\\)?기') THEN 'prior' WHEN contains(c, '당기') OR regexp_matches(c, '제\\d+\\(?당\\)?기') THEN 'current' END"


def rnd(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def clusters(values: str) -> str:
    """Running-mean clusters of a sorted list, as a fold: [{s, n}]."""
    return f"list_reduce(list_transform(list_sort({values}), lambda center_: [{{'s': center_, 'n': 1}}]), lambda a, e: CASE WHEN abs(a[-1].s / a[-1].n - e[1].s) <= 12 THEN list_append(a[1:len(a) - 1], {{'s': a[-1].s + e[1].s, 'n': a[-1].n + 1}}) ELSE list_append(a, e[1]) END)"


def bands(centers: str, keys: str, name: str) -> str:
    return f"""{name}_last AS (SELECT * FROM {centers} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY center DESC, seen DESC) <= 6),
    {name} AS (SELECT {keys}, key, row_number() OVER w - 1 AS band_ord, {rnd('CASE WHEN lag(center) OVER w IS NULL THEN center - greatest(40, width * 1.5) ELSE (lag(center) OVER w + center) / 2 END')} AS x1, {rnd('CASE WHEN lead(center) OVER w IS NULL THEN center + greatest(40, width * 1.5) ELSE (center + lead(center) OVER w) / 2 END')} AS x2 FROM {name}_last WINDOW w AS (PARTITION BY {keys} ORDER BY center, seen))"""


EVIDENCE = f"""{CELLS}, rounded AS (SELECT document_id, page_number, row_index, cell_index, {rnd('x')} AS x, {rnd('width')} AS width, text, {_NUMERIC} AS numeric, regexp_replace(text, '{WS}+', '', 'g') AS c FROM cells WHERE cell_index < 18 AND row_index < 140),
    erows AS (SELECT document_id, page_number, row_index, string_agg(text, ' ' ORDER BY cell_index) AS text, count(*) FILTER (numeric) AS numeric_cell_count FROM rounded GROUP BY ALL),
    kinds AS (SELECT *, CASE WHEN regexp_matches(c, '^(?:연결|개별|별도)?(?:포괄)?(?:재무상태표|손익계산서|현금흐름표|자본변동표)$') THEN 'title' WHEN contains(c, '단위') OR regexp_matches(c, '20\\d{{2}}|제\\d+') THEN 'header' WHEN numeric_cell_count > 0 THEN 'data' ELSE 'text' END AS kind FROM (SELECT *, regexp_replace(text, '{WS}+', '', 'g') AS c FROM erows) x),
    heads AS (SELECT document_id, page_number, key, avg(x + width / 2) AS center, greatest(30, avg(width)) AS width, min((row_index, cell_index)) AS seen FROM (SELECT *, {_PERIOD} AS key FROM rounded WHERE row_index < 30) h WHERE key IS NOT NULL GROUP BY 1, 2, 3),
    numbers AS (SELECT document_id, page_number, list(x + width / 2) AS centers FROM rounded r JOIN kinds k USING (document_id, page_number, row_index) WHERE r.numeric AND k.kind = 'data' AND (document_id, page_number) NOT IN (SELECT (document_id, page_number) FROM heads) GROUP BY ALL),
    grown AS (SELECT document_id, page_number, {clusters('centers')} AS cl FROM numbers),
    means AS (SELECT document_id, page_number, unnest(cl) AS m, generate_subscripts(cl, 1) - greatest(len(cl) - 6, 0) AS i FROM grown),
    centers AS (SELECT document_id, page_number, key, center, width, seen FROM heads UNION ALL SELECT document_id, page_number, 'period_' || i, m.s / m.n, 40, (i, 0) FROM means WHERE i > 0),
    {bands('centers', 'document_id, page_number', 'band')},
    valued AS (SELECT r.document_id, r.page_number, r.row_index, r.cell_index, CASE WHEN r.numeric THEN arg_min(b.key, b.band_ord) FILTER (r.x + r.width / 2 BETWEEN b.x1 AND b.x2) END AS col FROM rounded r LEFT JOIN band b USING (document_id, page_number) GROUP BY r.document_id, r.page_number, r.row_index, r.cell_index, r.numeric)"""

# ---- the queries ------------------------------------------------------------------------------------------------------------

_REF = f"""refs AS (SELECT * FROM {V.references_demo_sql(DUCK)} v), cells AS (SELECT * FROM {V.cells_demo_sql(DUCK)} v), listed AS (SELECT document_id, row_pos, column_key, page, row_index, unnest(cell_indices) AS cell_index, generate_subscripts(cell_indices, 1) AS pos FROM refs),
    got AS (SELECT l.document_id, l.row_pos, l.column_key, bool_and(c.text IS NOT NULL) AS valid, string_agg(c.text, '' ORDER BY pos) AS text, {rnd('min(c.x)')} AS x1, {rnd('min(c.y)')} AS y1, {rnd('max(c.x + c.width)')} AS x2, {rnd('max(c.y + c.height)')} AS y2 FROM listed l LEFT JOIN cells c ON c.document_id = l.document_id AND c.page_number = l.page AND c.row_index = l.row_index AND c.cell_index = l.cell_index GROUP BY ALL)"""
_BALANCE = "SELECT {by}, arg_max_null(value, fact_ord) FILTER (concept = 'Assets') AS a, arg_max_null(value, fact_ord) FILTER (concept = 'Liabilities') AS l, arg_max_null(value, fact_ord) FILTER (concept = 'Equity') AS e FROM {facts} GROUP BY ALL"
_SPANS = f"(SELECT * FROM {V.spans_demo_sql(DUCK)} s)"


def oracle_sql() -> dict[str, str]:
    docs = "SELECT doc_id, length({0}) AS n, md5({0}) AS digest FROM documents"
    spelled = "[" + ", ".join(map(q, ["thousand_KRW", "백 만 원", "hundred_million_KRW", "십억원", "won", "USD", " KRW ", "", "천원"])) + "][o_orderkey % 9 + 1]"
    limits = "(VALUES ('gemini-2.5-flash-lite', 0, 1048576, 65536), ('gemini-2.5-pro', 1, 1048576, 65536), ('gemini-1.5-pro', 2, 2097152, 8192), ('gpt-5.4-mini', 3, 400000, 128000), ('gpt-4o', 4, 128000, 16384), ('o1-preview', 5, 128000, 32768), ('o1-mini', 6, 128000, 65536), ('other', 7, NULL, NULL)) l(model, i, mi, mo)"
    runs = f"(SELECT id, created_at, seq, CASE WHEN filename = '' THEN 'Untitled extraction' ELSE filename END AS filename, files, report_types, n_candidates, n_facts, n_issues FROM {V.runs_demo_sql(DUCK)} v)"
    found = {
        "q01_compact_text": docs.format(compact("text")),
        "q02_normalize_ws": docs.format(squeezed("text")),
        "q03_page_lines": "SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_index FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n+') AS ls FROM documents) d",
        "q04_parse_amount": f"SELECT o_orderkey, {number('raw')} AS number FROM {V.amount_strings_sql(DUCK)} v",
        "q05_unit_scale": f"SELECT o_orderkey, {number('raw')} * coalesce({factor('unit')}, scale) AS amount, {unit_label(spelled)} AS unit_label FROM {V.amount_strings_sql(DUCK)} v",
        "q06_concept_map": f"WITH {LINES} SELECT document_id, page_number, idx AS line_index, {concept('line')} AS concept FROM lines",
        "q07_balance_check": f"SELECT 'critical' AS severity, 'Assets = Liabilities + Equity' AS check_name, 'Balance sheet equation does not reconcile.' AS message, scope, period, 'Assets' AS concept, round(l + e, 2) AS expected, round(a, 2) AS actual, round(a - (l + e), 2) AS difference FROM ({_BALANCE.format(by='scope, period', facts=V.facts_demo_sql(DUCK) + ' f')}) g WHERE abs(a - (l + e)) > 1",
        "q08_scope_carry": f"SELECT event_id, last_value(detected IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope FROM {V.scope_marks_sql(DUCK)} v",
        "q09_forward_text_window": f"WITH {PAGES} SELECT p.document_id, p.page_number, length(string_agg(n.text, chr(10) ORDER BY n.page_number)) AS n, md5(string_agg(n.text, chr(10) ORDER BY n.page_number)) AS digest FROM pages p JOIN pages n ON n.document_id = p.document_id AND n.page_number BETWEEN p.page_number AND p.page_number + 3 GROUP BY 1, 2",
        "q10_titles": f"WITH {TITLES} SELECT document_id, page_number, idx AS line_index, kind AS statement_type, prefixed AS has_section_prefix FROM titles",
        "q11_slice": f"WITH {TITLES}, {slices('pages', 'titles', 'seg')} SELECT document_id, page_number, kind AS statement_type, segment FROM seg",
        "q12_page_score": f"WITH {SCORED} SELECT document_id, page_number, kind AS statement_type, score, n_rows, n_numbers FROM scored",
        "q13_span_end": f"WITH {SPANS} SELECT * FROM candidates",
        "q14_first_wins_dedupe": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1",
        "q15_overlap_best_match": f"SELECT document_id, candidate_ord, segment_ord, overlap, greatest(start_page, s) AS low, least(end_page, e) AS high FROM (SELECT c.*, g.candidate_ord AS segment_ord, g.start_page AS s, g.end_page AS e, greatest(0, least(g.end_page, c.end_page) - greatest(g.start_page, c.start_page) + 1) * CASE WHEN g.candidate_ord IS NULL THEN NULL ELSE 1 END AS overlap FROM {_SPANS} c LEFT JOIN {V.segments_demo_sql(DUCK)} g ON g.document_id = c.document_id AND g.statement_type = c.statement_type AND (g.scope = c.scope OR g.scope = 'unknown' OR c.scope = 'unknown') AND g.start_page <= c.end_page AND c.start_page <= g.end_page QUALIFY row_number() OVER (PARTITION BY c.document_id, c.candidate_ord ORDER BY overlap DESC NULLS LAST, g.score DESC, g.candidate_ord) = 1) x",
        "q16_band_join": f"WITH cells AS (SELECT * FROM {V.cells_demo_sql(DUCK)} v), centers AS (SELECT document_id, CAST(cell_index AS VARCHAR) AS key, avg(x + width / 2) AS center, greatest(30, avg(width)) AS width, min((page_number, row_index, cell_index)) AS seen FROM cells WHERE row_index = 0 GROUP BY 1, 2), {bands('centers', 'document_id', 'band')} SELECT c.document_id, c.page_number, c.row_index, c.cell_index, arg_min(b.key, b.band_ord) FILTER (c.x + c.width / 2 BETWEEN b.x1 AND b.x2) AS value_column FROM cells c LEFT JOIN band b USING (document_id) GROUP BY 1, 2, 3, 4",
        "q17_running_mean_clusters": f"WITH grown AS (SELECT document_id, page_number, {clusters('list(x + width / 2)')} AS cl FROM {V.cells_demo_sql(DUCK)} v GROUP BY 1, 2) SELECT document_id, page_number, cluster, round(m.s / m.n, 3) AS mean FROM (SELECT document_id, page_number, unnest(cl) AS m, generate_subscripts(cl, 1) - 1 AS cluster FROM grown) g",
        "q18_first_fit_rows": f"WITH {CELLS} SELECT * FROM cells",
        "q19_cell_ref_semi_join": f"WITH {_REF} SELECT r.document_id, r.row_pos, r.column_key, coalesce(valid, false) AS valid FROM refs r LEFT JOIN got USING (document_id, row_pos, column_key)",
        "q20_cell_read": f"WITH {_REF} SELECT * EXCLUDE (valid) FROM got WHERE valid",
        "q21_cash_flow_filter": f"WITH {LINES}, labels AS (SELECT document_id, page_number AS candidate_ord, idx AS row_ord, 'cash_flow_statement' AS statement_type, regexp_replace(line, '[0-9,()]', '', 'g') AS label FROM lines), {cash_flow('labels', 'cf')} SELECT document_id, candidate_ord, row_ord, label FROM cf",
        "q22_text_metrics": f"WITH {TITLES}, {slices('pages', 'titles', 'seg')}, taken AS (SELECT *, 0 AS candidate_ord FROM (SELECT document_id, page_number, kind, segment FROM seg) s), one AS (SELECT * REPLACE ({TYPE_ORD} AS candidate_ord) FROM taken), {metrics('one', 'm')} SELECT document_id, page_number, kind AS statement_type, line_index, label, value, all_values, unit, scale, period, period_labels FROM m",
        "q23_tier_fallback": "SELECT event_id, document_id, candidate_ord, event_type, tier FROM (SELECT *, min(tier) OVER (PARTITION BY document_id, candidate_ord) AS best FROM (SELECT event_id, concat('U', user_id) AS document_id, CAST(dayofyear(ts) AS INT) AS candidate_ord, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS tier FROM events) e) x WHERE tier = best",
        "q24_toc_parse": f"WITH {ENTRIES} SELECT document_id, entry_ord, title, expected_page FROM entries",
        "q25_toc_match": f"WITH {CHECKS} SELECT * FROM checks",
        "q26_report_type": f"WITH {PAGES}, {TYPES} SELECT document_id, report_type, confidence, type_reasons FROM types",
        "q27_xbrl_contexts": f"SELECT context_ref, arg_max(scope, fact_ord) AS scope, arg_max(period, fact_ord) AS period, count(*) AS n_facts FROM (SELECT *, regexp_replace(scope || '_' || CASE WHEN period = '' THEN 'unknown' ELSE period END, '[ .]', '_', 'g') AS context_ref FROM {V.facts_demo_sql(DUCK)} f) x GROUP BY 1",
        "q28_statement_pivot": f"WITH {DISPLAY} SELECT scope, statement_type, extraction_order, fact_ord, {_LABEL} AS account, regexp_matches(regexp_replace(label, '{WS}+', '', 'g'), '{W.TOTAL_ROWS}') AS is_total, {shown('all_values[1]')} AS v0, {shown('all_values[2]')} AS v1, {shown('all_values[3]')} AS v2 FROM rows",
        "q29_column_labels": f"WITH {COLUMNS} SELECT * FROM columns",
        "q30_history_upsert": f"WITH u AS (SELECT *, 0 AS n FROM {runs} a WHERE seq % 3 <> 0 UNION ALL SELECT *, 1 FROM {runs} b WHERE seq % 3 = 0) SELECT id, seq, filename, n_facts FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, seq DESC) = 1) x ORDER BY n DESC, seq DESC, id LIMIT 50",
        "q31_history_find": f"SELECT w.name, w.size, arg_max(s.id, s.seq) AS run_id FROM (SELECT DISTINCT concat('f', c_custkey, '.pdf') AS name, c_custkey * 1000 AS size FROM customer WHERE c_custkey >= 0) w LEFT JOIN (SELECT id, seq, unnest(files) AS f FROM {runs} r) s ON s.f.name = w.name AND s.f.size = w.size GROUP BY 1, 2",
        "q32_json_recover": f"SELECT conv_id, turn, CASE WHEN kind < 3 THEN conv_id END AS n, CASE WHEN kind < 3 THEN role END AS role FROM (SELECT c.conv_id, c.turn, c.role, (c.conv_id + c.turn) % 5 AS kind FROM conversations c) x",
        "q33_token_admission": f"SELECT conv_id, turn, model, estimated_input, requested_output, input_limit, output_limit, CASE WHEN estimated_input > input_limit THEN 'input' WHEN requested_output > output_limit THEN 'output' END AS refusal FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 16384 ELSE least(8192, output_limit) END AS requested_output FROM (SELECT conv_id, turn, model, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) + CASE WHEN turn % 2 = 0 THEN 400000 ELSE 0 END AS estimated_input, coalesce(mi, CASE WHEN conv_id % 2 = 0 THEN 1048576 ELSE 128000 END) AS input_limit, coalesce(mo, CASE WHEN conv_id % 2 = 0 THEN 65536 ELSE 16384 END) AS output_limit FROM conversations JOIN {limits} ON i = conv_id % 8) a) b",
        "q34_broad_range": f"WITH {CHECKS}, ends AS (SELECT document_id, start_page AS a, end_page AS b FROM {_SPANS} s UNION ALL SELECT document_id, coalesce(found_page, expected_page), coalesce(found_page, expected_page) FROM checks WHERE {any_of('title', ['재무상태표', '손익계산서', '현금흐름표', '자본변동표'])}) SELECT d.document_id, coalesce(greatest(1, min(a) - 2), 1) AS start_page, least(any_value(page_count), coalesce(max(b) + 2, 20)) AS end_page FROM docs d LEFT JOIN ends e ON e.document_id = d.document_id GROUP BY 1",
        "q35_evidence_rows": f"WITH {EVIDENCE} SELECT k.document_id, k.page_number, k.row_index, k.kind, k.numeric_cell_count, k.text, string_agg(coalesce(v.col, '.'), '|' ORDER BY v.cell_index) AS value_columns FROM kinds k JOIN valued v USING (document_id, page_number, row_index) GROUP BY ALL",
        "q36_structure_facts": f"""WITH cells AS (SELECT * FROM {V.cells_demo_sql(DUCK)} v), d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), refs AS (SELECT * FROM (VALUES (0, '2024', 1, 0, 1, 0), (0, '2023', 1, 0, 1, 1), (0, '2023', 1, 0, 2, 0), (1, '2024', 2, 0, 1, 0), (1, '2023', 2, 50, 1, 0)) v(row_pos, key, page, row_index, pos, cell_index)),
            got AS (SELECT k, row_pos, key, page, string_agg(c.text, '' ORDER BY pos) AS text FROM d CROSS JOIN refs LEFT JOIN cells c ON c.document_id = 'O' || k AND c.page_number = page AND c.row_index = refs.row_index AND c.cell_index = refs.cell_index GROUP BY 1, 2, 3, 4 HAVING bool_and(c.text IS NOT NULL)),
            cols AS (SELECT DISTINCT k, key, CASE WHEN k % 3 = 0 THEN key ELSE translate(key, '34', '43') END AS ord, CASE WHEN k % 3 <> 0 AND key = '2024' THEN '당기' ELSE key END AS lbl FROM got),
            grid AS (SELECT r.k, r.row_pos, c.key, ord, lbl, coalesce(text, '') AS text, page FROM (SELECT DISTINCT k, row_pos FROM got) r JOIN cols c ON c.k = r.k LEFT JOIN got g ON g.k = r.k AND g.row_pos = r.row_pos AND g.key = c.key),
            f AS (SELECT k, row_pos, list(text ORDER BY ord) AS vals, list(key ORDER BY ord) AS keys, list(lbl ORDER BY ord) AS lbls, arg_min(page, key) FILTER (page IS NOT NULL) AS page, CASE row_pos WHEN 0 THEN '자산 총계' ELSE '부채 ' || k END AS label FROM grid GROUP BY 1, 2 HAVING max(text) <> ''),
            g AS (SELECT *, list_filter(vals, lambda x: x <> '')[1] AS v FROM f)
            SELECT 'O' || k AS document_id, 0 AS candidate_ord, CAST(row_number() OVER (PARTITION BY k ORDER BY row_pos DESC) - 1 AS INT) AS row_ord, label, {concept('label')} AS concept, keys[1] AS period, {number('v')} * 1000 AS value, '천원' AS unit, page AS page_number, array_to_string(vals, '|') AS all_values, array_to_string(keys, '|') AS period_labels, array_to_string(lbls, '|') AS column_labels FROM g""",
        "q37_vision_facts": f"""WITH r AS (SELECT s.document_id, s.candidate_ord, s.start_page, json_extract_string(response, '$.unit') AS raw_unit, unnest(CAST(json_extract(response, '$.rows') AS JSON[])) AS item, generate_subscripts(CAST(json_extract(response, '$.rows') AS JSON[]), 1) AS pos FROM {V.vision_json_sql(DUCK)} v JOIN {_SPANS} s USING (document_id, candidate_ord)),
            f AS (SELECT *, trim(coalesce(json_extract_string(item, '$.label'), '')) AS label, coalesce(json_extract_string(item, '$.values.c1'), '') AS c1, coalesce(json_extract_string(item, '$.values.c2'), '') AS c2 FROM r),
            k AS (SELECT *, {unit_label('raw_unit')} AS unit, CASE WHEN c1 <> '' THEN c1 ELSE c2 END AS v FROM f WHERE label <> '' AND (c1 NOT IN ('', '-') OR c2 NOT IN ('', '-')))
            SELECT document_id, candidate_ord, CAST(row_number() OVER (PARTITION BY document_id, candidate_ord ORDER BY pos) - 1 AS INT) AS row_ord, label, {concept('label')} AS concept, 'c1' AS period, {number('v')} * coalesce({factor('unit')}, 1) AS value, unit, start_page AS page_number, c1 || '|' || c2 AS all_values, '당기|c2' AS column_labels, CASE WHEN pos = 2 THEN '3' ELSE '' END AS notes FROM k""",
        "q38_segment_normalise": f"""WITH r AS (SELECT document_id, page_count, unnest(CAST(json_extract(response, '$.segments') AS JSON[])) AS item, generate_subscripts(CAST(json_extract(response, '$.segments') AS JSON[]), 1) AS pos FROM {V.segments_json_sql(DUCK)} v JOIN {V.report_documents_sql(DUCK)} d USING (document_id)),
            f AS (SELECT document_id, page_count, pos, json_extract_string(item, '$.statement_type') AS statement_type, CASE WHEN json_extract_string(item, '$.scope') IN ('consolidated', 'separate', 'unknown') THEN json_extract_string(item, '$.scope') ELSE 'unknown' END AS scope, CASE WHEN json_type(item, '$.start_page') = 'NULL' THEN 0 ELSE try_cast(json_extract_string(item, '$.start_page') AS DOUBLE) END AS a, CASE WHEN json_type(item, '$.end_page') = 'NULL' THEN 0 ELSE try_cast(json_extract_string(item, '$.end_page') AS DOUBLE) END AS b,
                CAST(floor(CASE WHEN json_type(item, '$.confidence') = 'NULL' THEN 0 ELSE coalesce(try_cast(json_extract_string(item, '$.confidence') AS DOUBLE), 0.7) END * 100 + 0.5) AS INT) AS score, json_extract_string(item, '$.reason') AS reason FROM r),
            k AS (SELECT document_id, pos, statement_type, scope, CAST(least(least(page_count, greatest(1, a)), least(page_count, greatest(1, b))) AS INT) AS start_page, CAST(greatest(least(page_count, greatest(1, a)), least(page_count, greatest(1, b))) AS INT) AS end_page, score, concat_ws(',', 'llm_segmenter', reason) AS reasons FROM f WHERE a = floor(a) AND b = floor(b) AND statement_type <> 'notes'),
            u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY document_id, scope, statement_type, start_page, end_page ORDER BY pos) = 1)
            SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start_page, score DESC, pos) - 1 AS INT) AS candidate_ord, scope, statement_type, start_page, end_page, score, reasons FROM u""",
        "q39_span_pages": f"WITH {PAGES} SELECT s.document_id, s.candidate_ord, p.page_number, length(p.text) AS n FROM {_SPANS} s JOIN pages p ON p.document_id = s.document_id AND p.page_number BETWEEN s.start_page AND s.end_page WHERE s.include",
        "q40_section_checks": f"WITH {SECTIONS} SELECT * FROM sections",
        "q41_review_issues": f"WITH {ISSUES} SELECT t.document_id, CASE coalesce(max(CASE WHEN severity = 'high' THEN 2 ELSE 1 END) FILTER (severity IS NOT NULL), 0) WHEN 2 THEN 'error' WHEN 1 THEN 'warn' ELSE 'ok' END AS status, nullif(count(severity), 0) AS n_issues, md5(string_agg(severity || ':' || message, chr(10) ORDER BY step, ord)) AS digest FROM types t LEFT JOIN issues i USING (document_id) GROUP BY 1",
        "q42_display_groups": f"WITH {COLUMNS}, odd AS (SELECT scope, statement_type FROM (SELECT scope, statement_type, lower(regexp_replace(raw, '{WS}+', '', 'g')) AS x FROM raw WHERE statement_type = 'equity_changes') r GROUP BY ALL HAVING bool_or({_SUSPECT}) UNION SELECT scope, statement_type FROM columns WHERE statement_type = 'equity_changes' AND regexp_matches(column_label, '^Column \\d+$') UNION SELECT scope, statement_type FROM groups WHERE statement_type = 'equity_changes' AND (scope, statement_type) NOT IN (SELECT (scope, statement_type) FROM raw)) SELECT scope, statement_type, CASE WHEN scope = 'unknown' THEN {_NAME['kind']} ELSE {_NAME['scope']} || ' ' || {_NAME['kind']} END AS title, CASE unit WHEN 'KRW' THEN '단위: 원' ELSE '단위: ' || unit END AS unit_caption, n_rows, column_count, CASE scope WHEN 'consolidated' THEN 0 WHEN 'separate' THEN 10 ELSE 20 END + CASE statement_type WHEN 'balance_sheet' THEN 0 WHEN 'income_statement' THEN 1 WHEN 'cash_flow_statement' THEN 2 ELSE 3 END AS statement_order, (scope, statement_type) IN (SELECT (scope, statement_type) FROM odd) AS repaired FROM groups",
        "q43_type_counts": f"SELECT document_id, statement_type, count(*) AS n, bool_or(include) AS confirmed, max(end_page - start_page + 1) AS longest FROM {_SPANS} s GROUP BY 1, 2",
        "q44_page_scope": f"WITH {PAGES}, {SCOPES} SELECT * FROM scopes",
        "q45_span_start": f"WITH {SEGMENTS}, {PAGE_FLAGS} SELECT document_id, page_number, kind AS statement_type, n_rows, n_numbers, n_valued, {GOES_ON} AS goes_on, n_rows >= 1 AND n_numbers >= 6 AND n_valued >= 2 AS strong, other_section, tail FROM ev JOIN flags USING (document_id, page_number)",
        "q51_broad_pages": f"WITH {PAGES}, docs AS (SELECT * FROM {V.report_documents_sql(DUCK)} d), ranges AS (SELECT d.document_id, coalesce(greatest(1, min(start_page) - 2), 1) AS a, least(any_value(page_count), coalesce(max(end_page) + 2, 20)) AS b FROM docs d LEFT JOIN {_SPANS} s ON s.document_id = d.document_id GROUP BY 1) SELECT document_id, page_number, length(t) AS n, md5(t) AS digest FROM (SELECT p.document_id, page_number, CASE WHEN length(text) > 400 THEN left(text, 400) || chr(10) || '[TRUNCATED]' ELSE text END AS t FROM pages p JOIN ranges r ON r.document_id = p.document_id AND page_number BETWEEN a AND least(b, a + 7)) x",
        "q52_edited_spans": f"SELECT s.document_id, s.candidate_ord, coalesce(e.include, s.include) AS include, coalesce(e.scope, s.scope) AS scope, coalesce(e.start_page, s.start_page) AS start_page, s.end_page FROM {_SPANS} s LEFT JOIN {V.edits_demo_sql(DUCK)} e ON e.document_id = s.document_id AND e.candidate_ord = s.candidate_ord",
        "q53_xbrl_units": f"SELECT upper(measure) AS unit_ref, arg_max(measure, fact_ord) AS measure FROM (SELECT fact_ord, CASE fact_ord % 4 WHEN 0 THEN 'krw' WHEN 1 THEN 'KRW' WHEN 2 THEN '천원' ELSE 'Usd' END AS measure FROM {V.facts_demo_sql(DUCK)} f) x GROUP BY 1",
        "q54_history_delete": f"SELECT id, seq, filename FROM {runs} r WHERE id NOT IN (SELECT concat('R', s_suppkey * 7) FROM supplier)",
        "q55_image_tokens": f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE CAST(ceil(p_size * 40.0 * (p_partkey % 1000) / 750) + ceil(length(p_name) * (1 + p_size) / 1024) AS BIGINT) END AS tokens FROM {V.images_demo_sql(DUCK)} v",
        "q56_model_limits": "WITH limits(model, provider, tier, input_limit, output_limit) AS (VALUES ('gemini-2.5-flash-lite', 'gemini', 'speed', 1048576, 65536), ('gemini-2.5-pro', 'gemini', 'quality', 1048576, 65536), ('gemini-1.5-pro', 'gemini', 'quality', 2097152, 8192), ('gpt-5.4-mini', 'openai', 'speed', 400000, 128000), ('gpt-4o', 'openai', 'quality', 128000, 16384), ('o1-preview', 'openai', 'quality', 128000, 32768), ('o1-mini', 'openai', 'speed', 128000, 65536)) SELECT conv_id, turn, l.* FROM conversations c JOIN limits l ON l.provider = CASE WHEN conv_id % 2 = 0 THEN 'gemini' ELSE 'openai' END AND l.tier = CASE WHEN turn % 2 = 0 THEN 'speed' ELSE 'quality' END",
        "q57_history_restored": f"SELECT concat('R', fact_ord // 3) AS run_id, scope, period, concept, fact_ord * 0.5::DOUBLE AS value, fact_ord FROM {V.facts_demo_sql(DUCK)} f WHERE concat('R', fact_ord // 3) IN (SELECT id FROM {runs} r)",
        "q58_document_facts": f"SELECT fact_ord, regexp_replace(scope || '_' || CASE WHEN period = '' THEN 'unknown' ELSE period END, '[ .]', '_', 'g') AS context_ref, 'KRW' AS unit_ref, concept FROM {V.facts_demo_sql(DUCK)} f",
        "q47_history_listing": f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, filename, array_to_string(report_types, ', ') AS types, CASE WHEN total = 0 THEN '' WHEN total >= 1048576 THEN printf('%.1f MB', total / 1048576) WHEN total >= 1024 THEN printf('%.1f KB', total / 1024) ELSE total || ' B' END AS size, n_candidates, n_facts, n_issues, seq FROM (SELECT *, CAST(files[1].size + files[2].size AS BIGINT) AS total FROM {runs} r) x",
        "q48_pipeline_issues": f"WITH {FACTS} SELECT document_id, scope, period, l + e AS expected, a AS actual, a - (l + e) AS difference FROM ({_BALANCE.format(by='document_id, scope, period', facts='(SELECT *, (candidate_ord, row_ord) AS fact_ord FROM facts) f')}) g WHERE abs(a - (l + e)) > 1",
        "q49_pipeline_facts": f"WITH {FACTS} SELECT document_id, filename, scope, statement_type, concept, label, period, value, unit, page_number, raw_line, all_values, extraction_order FROM facts",
        "q50_provider_fallback": "WITH a AS (SELECT conv_id, turn AS provider_ord, concat('p', turn) AS provider, nullif(regexp_replace(regexp_replace(CASE WHEN length(text) % 3 = 0 THEN text ELSE ' ' END, '^" + WS + "+', ''), '" + WS + "+$', ''), '') AS answer FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN length(text) % 3 = 0 THEN text ELSE ' ' END NULLS FIRST) = 1) c) SELECT conv_id, arg_min(provider, provider_ord) FILTER (answer IS NOT NULL) AS provider, arg_min(answer, provider_ord) FILTER (answer IS NOT NULL) AS response, CASE WHEN count(answer) = 0 THEN string_agg(provider || ': returned an empty response.', ' | ' ORDER BY provider_ord) END AS errors FROM a GROUP BY 1",
        "q59_called_answers": """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(text, '')) = 1),
            r AS (SELECT *, turn * 40000 + (n + 3) // 4 > 2097152 AS no_g, turn * 40000 + (n + 3) // 4 > 128000 AS no_o FROM t),
            g AS (SELECT *, NOT no_g AND n % 4 = 0 AS ok_g, CASE WHEN no_g THEN 0 WHEN n % 4 = 1 THEN 3 ELSE 1 END AS calls_g FROM r),
            o AS (SELECT *, NOT ok_g AND NOT no_o AND n % 3 <> 0 AS ok_o, CASE WHEN ok_g OR no_o THEN 0 WHEN n % 3 = 0 THEN 3 ELSE 1 END AS calls_o FROM g)
            SELECT conv_id, turn, CASE WHEN ok_g THEN 'gemini' WHEN ok_o THEN 'openai' END AS provider, CASE WHEN ok_g THEN 'gemini ' || n WHEN ok_o THEN 'openai ' || n END AS response,
                CASE WHEN NOT ok_g AND NOT ok_o THEN CASE WHEN no_g THEN 'gemini: refused: input tokens' WHEN n % 4 = 1 THEN 'gemini: busy' WHEN n % 4 = 2 THEN 'gemini: bad request' ELSE 'gemini: returned an empty response.' END || CASE WHEN no_o THEN ' | openai: refused: input tokens' ELSE ' | openai: busy' END END AS errors,
                calls_g + calls_o AS n_calls FROM o""",
        "q60_document_objects": f"""WITH f AS (SELECT *, regexp_replace(scope || '_' || CASE WHEN coalesce(period, '') = '' THEN 'unknown' ELSE period END, '[ .]', '_', 'g') AS context_ref, CASE fact_ord % 3 WHEN 2 THEN '천원' ELSE 'KRW' END AS unit_ref, CASE fact_ord % 3 WHEN 0 THEN 'krw' WHEN 1 THEN 'KRW' ELSE '천원' END AS measure FROM {V.facts_demo_sql(DUCK)} v)
            SELECT 'context' AS kind, context_ref AS ref, min(fact_ord) AS place, arg_max(scope, fact_ord) AS scope, arg_max(period, fact_ord) AS period, NULL AS measure, NULL AS concept, NULL AS context_ref, NULL AS unit_ref, NULL::DOUBLE AS value, NULL AS label, NULL AS filename FROM f GROUP BY context_ref
            UNION ALL SELECT 'unit', unit_ref, min(fact_ord), NULL, NULL, arg_max(measure, fact_ord), NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY unit_ref
            UNION ALL SELECT 'fact', CAST(fact_ord AS VARCHAR), fact_ord, NULL, NULL, NULL, concept, context_ref, unit_ref, fact_ord * 0.5::DOUBLE, '"' || concept || '" \\ 계정', 'd.pdf' FROM f""",
    }
    found["q61_refined_spans"] = f"""WITH c AS (SELECT * FROM {_SPANS} s), g AS ({found['q38_segment_normalise']}), told AS (SELECT DISTINCT document_id FROM g),
        best AS (SELECT c.*, g.candidate_ord IS NOT NULL AS matched, g.scope AS gs, g.start_page AS s, g.end_page AS e, g.score AS gscore, g.reasons AS gr, least(g.end_page, c.end_page) - greatest(g.start_page, c.start_page) AS overlap FROM c SEMI JOIN told ON told.document_id = c.document_id
            LEFT JOIN g ON g.document_id = c.document_id AND g.statement_type = c.statement_type AND (g.scope = c.scope OR g.scope = 'unknown' OR c.scope = 'unknown') AND g.start_page <= c.end_page AND c.start_page <= g.end_page
            QUALIFY row_number() OVER (PARTITION BY c.document_id, c.candidate_ord ORDER BY overlap DESC NULLS LAST, g.score DESC, g.candidate_ord) = 1),
        n AS (SELECT document_id, candidate_ord AS found_ord, include, statement_type, CASE WHEN matched AND gs <> 'unknown' THEN gs ELSE scope END AS scope, CASE WHEN matched THEN greatest(start_page, s) ELSE start_page END AS start_page, CASE WHEN matched THEN least(end_page, e) ELSE end_page END AS end_page,
            CASE WHEN matched THEN greatest(score, gscore) ELSE score END AS score, CASE WHEN matched THEN 'demo,' || gr || ',llm_range_clamped_to_heuristic' ELSE 'demo' END AS reasons FROM best),
        u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY document_id, scope, statement_type, start_page, end_page ORDER BY found_ord) = 1)
        SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY start_page, score DESC, found_ord) - 1 AS INT) AS candidate_ord, include, scope, statement_type, start_page, end_page, score, reasons FROM u
        UNION ALL SELECT document_id, candidate_ord, include, scope, statement_type, start_page, end_page, score, 'demo' FROM c WHERE document_id NOT IN (SELECT document_id FROM told)"""
    return found
