"""Account rows of confirmed spans as facts, the fallback between extractors, the fact filter and the assembled document.

facts: document_id, filename, scope, statement_type, concept, label, period, value, unit, page_number, confidence, raw_line,
all_values, period_labels, column_labels, notes, evidence (JSON), extraction_order - and fact_ord, a total order that no two facts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.amounts import amount, concept
from factloom.functions.rows import is_account, parsed_line, period_labels, period_of, period_parts, unit_scale
from factloom.functions.statements import cut, slice_bounds, titles
from factloom.functions.text import WS, let, lines, once, text
from factloom.functions.vocabulary import CASH_FLOW_END, CASH_FLOW_START, NOTE_ROWS
from factloom.operators.order import placed_anew

FACT_COLUMNS = ["document_id", "filename", "scope", "statement_type", "concept", "label", "period", "value", "unit", "page_number", "confidence", "raw_line", "all_values", "period_labels", "column_labels", "notes", "evidence", "extraction_order"]


def with_parsed(pages: DataFrame) -> DataFrame:
    """pages with lines, titles, parsed (the account rows among the lines: all, and first of equal ones) and told (unit, period, years of the whole text): once a page, however many statements it is read as."""
    page = pages if "titles" in pages.columns else pages.withColumn("lines", lines(F.col("text"))).withColumn("titles", titles(F.col("lines")))

    def account_row(line: Column, i: Column) -> Column:
        return let(parsed_line(line), lambda row: F.when(is_account(row.label), F.struct(i.alias("line_index"), line.alias("raw_line"), row.label.alias("label"), row["values"].alias("values"))))

    # lines are parsed and filtered inside one array, so each is parsed once
    rows = F.filter(F.transform("lines", account_row), lambda r: r.isNotNull())
    return page.withColumns({"parsed": let(rows, lambda all_: F.struct(all_.alias("all"), _first_of_equal(all_).alias("first"))), "told": _told(text(F.col("text")))})


def parsed_span_pages(pages: DataFrame) -> DataFrame:
    """What text_metrics() reads of pages (document_id, page_number, text, spans), each parsed once for all its spans."""
    parsed = with_parsed(pages.select("document_id", "page_number", "text", "spans"))
    return parsed.withColumn("span", F.explode(once("spans"))).select("document_id", "span.*", *[c for c in parsed.columns if c not in ("document_id", "spans")])


def _told(segment: Column) -> Column:
    return let(segment, lambda s: F.struct(unit_scale(s).alias("us"), period_parts(s).alias("period"), period_labels(s).alias("years")))


def _first_of_equal(rows: Column) -> Column:
    """Of rows of equal label and first value the first."""
    key = lambda r: F.struct(r["label"].alias("label"), r["values"][0].alias("value"))
    return let(F.transform(rows, key), lambda keys: F.filter(rows, lambda r, n: F.array_position(keys, key(r)) == n + 1))


def text_metrics(span_pages: DataFrame) -> DataFrame:
    """Account rows of span pages (document_id, candidate_ord, scope, statement_type, page_number, text; what with_parsed() adds, if there already).

    Unit, period and period labels are read once from the page's slice; of equal rows of a page the first stays. A page is one row of a span.
    """
    kind = F.col("statement_type")
    page = span_pages if "parsed" in span_pages.columns else with_parsed(span_pages)
    keys = [c for c in span_pages.columns if c not in ("text", "lines", "titles", "parsed", "told")]

    def of_slice(at: Column) -> Column:
        begin, end = F.coalesce(at["start"], F.lit(0)), F.coalesce(at["stop"], F.size("lines"))
        part = F.transform(F.filter("parsed.all", lambda r: r["line_index"].between(begin, end - 1)), lambda r: F.struct((r["line_index"] - begin).alias("line_index"), r["raw_line"].alias("raw_line"), r["label"].alias("label"), r["values"].alias("values")))
        # most slices hold all lines of a page, of which all is known already; one without rows tells nothing
        full = (begin == 0) & at["stop"].isNull()
        own = F.when(full, F.col("parsed.first")).otherwise(let(part, _first_of_equal))
        told = F.when(full, F.col("told")).otherwise(_told(cut(F.col("text"), F.col("lines"), at)))
        return let(own, lambda rows: F.struct(F.when(F.size(rows) > 0, told).alias("told"), rows.alias("rows")))

    # parted before the rows are taken out, or each would be given all of them to carry
    page = page.select(*keys, let(slice_bounds(F.col("titles"), kind), of_slice).alias("page")).select(*keys, "page.told", "page.rows")
    rows = page.select(*keys, "told", F.explode(once("rows")).alias("row"))
    values = F.col("row.values")
    return rows.select(*keys, "row.line_index", "row.label", values[0].alias("value"), values.alias("all_values"), F.col("told.us.unit").alias("unit"), F.col("told.us.scale").alias("scale"), period_of(F.col("told.period"), kind).alias("period"), F.lit(0.55).alias("confidence"), "row.raw_line", F.slice("told.years", F.lit(1), F.size(values)).alias("period_labels"))


def metrics_to_facts(metrics: DataFrame, documents: DataFrame) -> DataFrame:
    """Metrics as facts, numbered from 0 within their candidate."""
    order = W.partitionBy("document_id", "candidate_ord").orderBy("page_number", "line_index")
    named = metrics.join(documents.select("document_id", "filename"), "document_id", "left")
    none = F.array().cast("array<string>")
    return named.select(
        "document_id", "candidate_ord", "filename", "scope", "statement_type", concept(F.col("label")).alias("concept"), "label", "period",
        amount(F.col("value"), F.col("unit"), F.col("scale")).alias("value"), "unit", "page_number", "confidence", "raw_line", "all_values", "period_labels",
        F.col("period_labels").alias("column_labels"), none.alias("notes"), F.lit("{}").alias("evidence"), (F.row_number().over(order) - 1).cast("int").alias("row_ord"),
    )


def first_tier(*tiers: DataFrame) -> DataFrame:
    """For each candidate the facts of the first tier that has any."""
    union = None
    for n, tier in enumerate(tiers):
        tagged = placed_anew(tier).withColumn("tier", F.lit(n)) if len(tiers) > 1 else tier.withColumn("tier", F.lit(n))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return union.withColumn("best", F.min("tier").over(W.partitionBy("document_id", "candidate_ord"))).where("tier = best").drop("best")


def _label_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(text(label)), rf"""(?:{WS}|[(){{}}\[\]"'‘’“”,.·ㆍ:;/-])+""", "")


def _any(key: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | key.contains(part)
    return out


def is_cash_flow_start(label: Column) -> Column:
    return _any(_label_key(label), CASH_FLOW_START)


def is_cash_flow_end(label: Column) -> Column:
    return _any(_label_key(label), CASH_FLOW_END)


def is_note_row(label: Column) -> Column:
    """Blank labels count as notes."""
    key = _label_key(label)
    return (key == "") | _any(key, NOTE_ROWS)


def filtered_cash_flow(facts: DataFrame, order: str = "row_ord") -> DataFrame:
    """Of cash flow candidates, what lies from the first start row to the first end row after it, without note rows; others whole."""
    candidate = W.partitionBy("document_id", "candidate_ord")
    flow = F.col("statement_type") == "cash_flow_statement"
    marked = facts.withColumn("note", is_note_row(F.col("label"))).withColumn("first", F.coalesce(F.min(F.when(is_cash_flow_start(F.col("label")), F.col(order))).over(candidate), F.min(order).over(candidate)))
    marked = marked.withColumn("last", F.coalesce(F.min(F.when(is_cash_flow_end(F.col("label")) & ~F.col("note") & (F.col(order) >= F.col("first")), F.col(order))).over(candidate), F.max(order).over(candidate)))
    return marked.where(~flow | (~F.col("note") & F.col(order).between(F.col("first"), F.col("last")))).drop("note", "first", "last")


def numbered(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """extraction_order as it runs on over a document's candidates, and fact_ord.

    The order a candidate starts at counts only the facts that stayed of earlier ones, while its own rows keep their gaps: orders can
    repeat. fact_ord can't.
    """
    before = W.partitionBy("document_id").orderBy("candidate_ord").rangeBetween(W.unboundedPreceding, -1)
    joined = facts.withColumn("start", F.count("*").over(before)).join(documents.select("document_id", "doc_ord"), "document_id")
    # documents in their order, candidates and rows in theirs: one sortable key, no global sort
    ord_key = F.format_string("%012d:%08d:%08d:%s", F.col("doc_ord").cast("long"), F.col("candidate_ord"), F.col("row_ord"), F.col("document_id"))
    return joined.select(*[F.col(c) if c != "extraction_order" else (F.col("row_ord") + F.col("start")).cast("int").alias(c) for c in FACT_COLUMNS], ord_key.alias("fact_ord"))


# ---- checks and the document ------------------------------------------------------------------------------------------------

BALANCE = ("Assets", "Liabilities", "Equity")


def balance_issues(facts: DataFrame, tolerance: float = 1.0, by: tuple[str, ...] = ("scope", "period")) -> DataFrame:
    """Groups whose assets differ from liabilities plus equity by more than the tolerance.

    The last fact of a concept counts, and a last one without a finite value keeps the group from being checked. Only three
    concepts are read, so the shuffle carries three partial aggregates a group.
    """
    last = {name: F.max_by("value", F.when(F.col("concept") == name, F.col("fact_ord"))) for name in BALANCE}
    wanted = facts.where(F.col("concept").isin(*BALANCE)).select(*by, "concept", F.col("value").cast("double").alias("value"), "fact_ord")
    sums = wanted.groupBy(*by).agg(*[value.alias(name) for name, value in last.items()])
    finite = F.lit(True)
    for name in BALANCE:
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
    expected = F.col("Liabilities") + F.col("Equity")
    # check_name and message are part of the result rows.
    failed = sums.where(finite & (F.abs(F.col("Assets") - expected) > tolerance))
    return failed.select(F.lit("critical").alias("severity"), F.lit("Assets = Liabilities + Equity").alias("check_name"), F.lit("Balance sheet equation does not reconcile.").alias("message"), *by, F.lit("Assets").alias("concept"), expected.alias("expected"), F.col("Assets").alias("actual"), (F.col("Assets") - expected).alias("difference"))


def _context_ref() -> Column:
    return F.regexp_replace(F.concat_ws("_", "scope", F.coalesce(F.nullif(F.col("period"), F.lit("")), F.lit("unknown"))), "[ .]", "_")


def _unit() -> Column:
    return F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit("KRW"))


def document_facts(facts: DataFrame) -> DataFrame:
    """Facts with their references to contexts and units."""
    return facts.withColumns({"context_ref": _context_ref(), "unit_ref": F.upper(_unit())})


def contexts(facts: DataFrame) -> DataFrame:
    """context_ref, scope, period, n_facts: of facts with one reference the last names scope and period."""
    last = F.max_by(F.struct("scope", "period"), "fact_ord")
    return document_facts(facts).groupBy("context_ref").agg(last.alias("last"), F.count("*").alias("n_facts")).select("context_ref", "last.scope", "last.period", "n_facts")


def units(facts: DataFrame) -> DataFrame:
    return document_facts(facts).groupBy("unit_ref").agg(F.max_by(_unit(), "fact_ord").alias("measure"))


def document_objects(facts: DataFrame) -> DataFrame:
    """The objects of the assembled document - kind (context, unit, fact), ref, json - with their place in it.

    Contexts and units stand where the first fact that names them does (place), facts at their fact_ord.
    """
    options = {"ignoreNullFields": "false"}
    named = document_facts(facts)
    first, last = F.min("fact_ord").alias("place"), F.max_by(F.struct("scope", "period"), "fact_ord")
    context_rows = named.groupBy("context_ref").agg(last.alias("last"), first).select(F.lit("context").alias("kind"), F.col("context_ref").alias("ref"), F.to_json("last", options).alias("json"), "place")
    unit_rows = named.groupBy("unit_ref").agg(F.struct(F.max_by(_unit(), "fact_ord").alias("measure")).alias("last"), first).select(F.lit("unit").alias("kind"), F.col("unit_ref").alias("ref"), F.to_json("last", options).alias("json"), "place")
    source = F.struct(F.col("document_id").alias("documentId"), "filename", F.col("page_number").alias("page")).alias("source")
    body = F.struct("concept", F.col("context_ref").alias("contextRef"), F.col("unit_ref").alias("unitRef"), "value", "label", F.col("statement_type").alias("statementType"), source, "confidence", F.col("all_values").alias("allValues"), F.col("raw_line").alias("rawLine"), F.col("period_labels").alias("periodLabels"), F.col("column_labels").alias("columnLabels"), "notes", "evidence", F.col("extraction_order").alias("extractionOrder"))
    fact_rows = named.select(F.lit("fact").alias("kind"), F.col("fact_ord").cast("string").alias("ref"), F.to_json(body, options).alias("json"), F.col("fact_ord").alias("place"))
    return context_rows.unionByName(unit_rows).unionByName(fact_rows)


def document_json(facts: DataFrame, schema_name: str = "factloom-xbrl-like/v1") -> DataFrame:
    """One row per object of the assembled document: kind (schema, context, unit, fact), ref, json. sources.documents writes the document itself.

    A document over many facts never meets in one row.
    """
    head = facts.sparkSession.createDataFrame([("schema", "", f'{{"schema":"{schema_name}"}}')], "kind string, ref string, json string")
    return head.unionByName(document_objects(facts).select("kind", "ref", "json"))
