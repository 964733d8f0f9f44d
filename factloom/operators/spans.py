"""Where in a document the four core statements lie: candidate page spans, and the refinement of spans by a model's segments.

pages(document_id, page_number, text) -> candidates(document_id, candidate_ord, include, scope, statement_type, start_page,
end_page, score, reasons). Everything that looks at neighbouring pages is a window over one document in page order, so the pages
are shuffled once by document_id, however many of these steps there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.statements import by_type, cash_flow_tail, evidence, goes_on_with, has_title, heading_scope, is_strong, look, look_at_slice, looks_like_contents, page_scope, starts_other_section, statement_slice, titles
from factloom.functions.text import let, lines, page_range, squeezed
from factloom.functions.vocabulary import STATEMENT_TYPES, TITLE_REASON
from factloom.operators.order import carried, first_wins

#: Pages that a span may have.
MAX_SPAN = 4


def with_titles(pages: DataFrame) -> DataFrame:
    return pages.withColumn("lines", lines(F.col("text"))).withColumn("titles", titles(F.col("lines")))


def with_carried_scope(pages: DataFrame) -> DataFrame:
    """context_scope: the last scope that a heading told, up to and with the page."""
    # headings name the statements without a space; most pages hold none and are done with one look
    detected = pages.withColumn("detected_scope", F.when(F.col("text").contains("재무제표"), heading_scope(squeezed(F.col("text")))))
    return detected.withColumn("context_scope", carried("detected_scope", ["document_id"], "page_number"))


def forward_text(pages: DataFrame, span: int = MAX_SPAN) -> DataFrame:
    """forward_text: the texts of this page number and the next ones, joined by line breaks; missing pages are skipped."""
    ahead = W.partitionBy("document_id").orderBy("page_number").rangeBetween(0, span - 1)
    return pages.withColumn("forward_text", F.array_join(F.collect_list("text").over(ahead), "\n"))


def score(segment: Column, statement_type: str) -> Column:
    """score, rows, numbers, toc, strong of a segment that has the title; 0 without a row keyword or with fewer than six numbers."""

    def points(e: Column, toc: Column) -> Column:
        sum_ = F.lit(50) + F.least(F.lit(40), 8 * e.rows) + F.least(F.lit(30), e.numbers) - F.when(toc, 180).otherwise(0)
        return F.struct(F.when((e.rows >= 1) & (e.numbers >= 6), F.greatest(sum_, F.lit(0))).otherwise(0).alias("score"), e.rows.alias("rows"), e.numbers.alias("numbers"), toc.alias("toc"), is_strong(e).alias("strong"))

    return let(segment, lambda x: let(F.struct(evidence(x, statement_type).alias("e"), looks_like_contents(x).alias("toc")), lambda t: points(t.e, t.toc)))


def page_signals(pages: DataFrame, span: int = MAX_SPAN) -> DataFrame:
    """Each page with what span ends and starts are decided by, of itself and of the pages ahead.

    ahead: page_number, titled, other_section, tail and, by type, continues - of the next 2 * (span - 1) page numbers.
    """
    reach = 2 * (span - 1)
    document = W.partitionBy("document_id")
    order = document.orderBy("page_number")
    # lines and titles are found behind the shuffle
    signals = with_titles(with_carried_scope(pages)).withColumn("kinds", F.array_distinct(F.transform("titles", lambda t: t.statement_type)))
    # a page is asked only whether it goes on with what a page before it has a title of; most pages are asked nothing
    signals = signals.withColumn("recent", F.flatten(F.collect_list("kinds").over(order.rangeBetween(-reach, -1))))
    signals = signals.withColumn("page_look", F.when(F.size("recent") > 0, look(F.col("text"))))

    def asked(kind: str) -> Column:
        own = statement_slice(F.col("text"), F.col("lines"), F.col("titles"), F.lit(kind))
        seen = let(own, lambda segment: look_at_slice(segment, F.col("text"), F.col("page_look")))
        return F.when(F.array_contains("recent", kind), let(seen, lambda s: goes_on_with(s, kind))).otherwise(False)

    goes_on = F.struct(*[asked(kind).alias(kind) for kind in STATEMENT_TYPES])
    signals = signals.withColumn("signal", F.struct(F.col("page_number").alias("page_number"), (F.size("titles") > 0).alias("titled"), starts_other_section(F.col("text")).alias("other_section"), cash_flow_tail(F.col("text")).alias("tail"), goes_on.alias("continues"))).drop("recent", "page_look")
    return (
        forward_text(signals, span)
        .withColumn("ahead", F.collect_list("signal").over(order.rangeBetween(1, reach)))
        .withColumn("last_page", F.max("page_number").over(document))
        .withColumn("scope", page_scope(F.col("text"), F.col("context_scope")))
    )


def span_start(statement_type: Column, strong: Column, span: int) -> Column:
    """The page itself if its body is strong; else the first page ahead that goes on before another title, if there is one."""
    limit = F.least(F.col("last_page"), F.col("page_number") + span - 1)
    events = F.filter("ahead", lambda p: (p.page_number <= limit) & (p.titled | by_type(statement_type, lambda kind: p["continues"][kind])))
    return let(F.get(events, F.lit(0)), lambda first: F.when(~strong & ~first.titled, first.page_number).otherwise(F.col("page_number")))


def span_end(statement_type: Column, start: Column, span: int) -> Column:
    """The last page before, or with, the next title or other section; the longest span where neither comes."""
    limit = F.least(F.col("last_page"), start + span - 1)
    events = F.filter("ahead", lambda p: (p.page_number > start) & (p.page_number <= limit) & (p.titled | p.other_section))

    def end(first: Column) -> Column:
        goes_on = F.when(first.other_section, (statement_type == "cash_flow_statement") & first.tail).otherwise(by_type(statement_type, lambda kind: first["continues"][kind]))
        return F.when(first.isNull(), limit).when(goes_on, first.page_number).otherwise(F.greatest(start, first.page_number - 1))

    return let(F.get(events, F.lit(0)), end)


def scored_pages(pages: DataFrame, span: int = MAX_SPAN) -> DataFrame:
    """A row for each page and each statement whose title it has, with its score; titles without a body nearby are dropped."""

    def forward_score(kind: Column) -> Column:
        own = let(lines(F.col("forward_text")), lambda x: let(titles(x), lambda t: statement_slice(F.col("forward_text"), x, t, kind)))
        return let(own, lambda segment: by_type(kind, lambda k: score(segment, k)))

    def of_kind(kind: Column) -> Column:
        segment = statement_slice(F.col("text"), F.col("lines"), F.col("titles"), kind)
        return let(segment, lambda x: let(by_type(kind, lambda k: score(x, k)), lambda own: F.struct(kind.alias("statement_type"), own.strong.alias("strong"), F.when(own.score > 0, own).otherwise(forward_score(kind)).alias("scored"))))

    # scored and filtered inside one array: a filter over the rows would evaluate the score again
    found = F.filter(F.transform("kinds", of_kind), lambda f: f.scored.score > 0)
    return page_signals(pages, span).withColumn("found", F.explode(found)).select("document_id", "page_number", "scope", "ahead", "last_page", "found.*")


def discover_spans(pages: DataFrame, span: int = MAX_SPAN) -> DataFrame:
    """Candidate spans: scored, scoped, extended, the first of equal ones kept, in page order."""
    kind = F.col("statement_type")
    found = scored_pages(pages, span).withColumn("start_page", span_start(kind, F.col("strong"), span).cast("int"))
    found = found.withColumn("end_page", span_end(kind, F.col("start_page"), span).cast("int"))
    type_ord = by_type(kind, lambda k: F.lit(STATEMENT_TYPES.index(k)))
    reason = by_type(kind, lambda k: F.lit(TITLE_REASON[k]))
    reasons = F.concat(F.array(reason, F.concat(F.lit("statement_rows:"), F.col("scored.rows")), F.concat(F.lit("numeric_table:"), F.col("scored.numbers"))), F.when(F.col("scored.toc"), F.array(F.lit("toc_penalty"))).otherwise(F.array().cast("array<string>")))
    shaped = found.select("document_id", F.lit(True).alias("include"), "scope", "statement_type", "start_page", "end_page", F.col("scored.score").alias("score"), reasons.alias("reasons"), F.struct("page_number", type_ord).alias("found_ord"))
    return ordered(first_of_equal(shaped))


def first_of_equal(candidates: DataFrame, stays: Column | None = None) -> DataFrame:
    return first_wins(candidates, ["document_id", "scope", "statement_type", "start_page", "end_page"], "found_ord", stays=stays)


def ordered(candidates: DataFrame, stays: Column | None = None) -> DataFrame:
    """candidate_ord: by start page, the better score first. stays: candidates that keep the number they had (found_ord)."""
    order = W.partitionBy("document_id").orderBy("start_page", F.col("score").desc(), "found_ord")
    number = (F.row_number().over(order) - 1).cast("int")
    out = candidates.withColumn("candidate_ord", number if stays is None else F.when(stays, F.col("found_ord")).otherwise(number))
    return out.select("document_id", "candidate_ord", "include", "scope", "statement_type", "start_page", "end_page", "score", "reasons")


def edited(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """A reviewer's edits (document_id, candidate_ord and any of include, scope, start_page, end_page; null leaves as it is)."""
    keys = ["document_id", "candidate_ord"]
    changed = [c for c in ("include", "scope", "start_page", "end_page") if c in edits.columns]
    joined = candidates.join(edits.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changed]), keys, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in candidates.columns])


def span_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of each confirmed span; page numbers that the document lacks are skipped. An equi-join over the numbers of the span."""
    return _numbered(candidates).join(pages, ["document_id", "page_number"])


def _numbered(candidates: DataFrame) -> DataFrame:
    return candidates.where("include").withColumn("page_number", F.explode(page_range(F.col("start_page"), F.col("end_page"))))


def pages_with_spans(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that confirmed spans hold, each once, with all its spans: [candidate_ord, scope, statement_type]."""
    listed = _numbered(candidates).groupBy("document_id", "page_number").agg(F.collect_list(F.struct("candidate_ord", "scope", "statement_type")).alias("spans"))
    return listed.join(pages, ["document_id", "page_number"])


# ---- a model's segments -----------------------------------------------------------------------------------------------------


def normal_segments(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments out of JSON responses (document_id, response): known types and scopes, pages inside the document, first of equal ones.

    A page that is JSON null counts as 0 and so becomes page 1; one that is missing or no integer drops the segment.
    """
    from factloom.functions.json import json_text

    parsed = responses.join(documents.select("document_id", "page_count"), "document_id").withColumn("doc", F.from_json(json_text(F.col("response")), "segments array<string>"))
    rows = parsed.select("document_id", "page_count", F.posexplode("doc.segments").alias("pos", "item"))
    field = {name: F.get_json_object("item", f"$.{name}") for name in ("statement_type", "scope", "start_page", "end_page", "confidence", "reason", "start_anchor", "end_anchor")}
    keys = F.json_object_keys("item")

    def page(name: str) -> Column:
        number = F.when(F.array_contains(keys, name) & field[name].isNull(), F.lit(0.0)).otherwise(F.when(F.trim(field[name]) == "", 0.0).otherwise(field[name].try_cast("double")))
        return F.when(number == F.floor(number), F.least(F.col("page_count"), F.greatest(F.lit(1), number.cast("int"))))

    confidence = F.coalesce(F.when(F.array_contains(keys, "confidence") & field["confidence"].isNull(), 0.0), field["confidence"].try_cast("double"), F.lit(0.7))
    notes = F.filter(F.array(F.lit("llm_segmenter"), *[F.coalesce(field[c], F.lit("")) for c in ("reason", "start_anchor", "end_anchor")]), lambda x: x != "")
    shaped = rows.select("document_id", "pos", field["statement_type"].alias("statement_type"), F.when(field["scope"].isin("consolidated", "separate", "unknown"), field["scope"]).otherwise("unknown").alias("scope"), page("start_page").alias("a"), page("end_page").alias("b"), F.floor(confidence * 100 + 0.5).cast("int").alias("score"), notes.alias("reasons"))
    known = shaped.where(F.col("statement_type").isin(STATEMENT_TYPES) & F.col("a").isNotNull() & F.col("b").isNotNull())
    known = known.select("document_id", F.lit(True).alias("include"), "scope", "statement_type", F.least("a", "b").alias("start_page"), F.greatest("a", "b").alias("end_page"), "score", "reasons", F.col("pos").alias("found_ord"))
    return ordered(first_of_equal(known))


def best_overlap(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Each candidate with the segment of its type and a fitting scope that overlaps it most, else with nulls.

    The largest overlap, then score, then order wins.
    """
    return _first_of_candidate(_with_best(candidates, segments))


def _with_best(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """candidates with overlap, seg and told (has the document any segment?).

    A document has a handful of segments, which meet its candidates as one array: both are dealt by document, and so is all that follows.
    """
    listed = F.struct("statement_type", "scope", "start_page", "end_page", "score", "reasons", F.col("candidate_ord").alias("ord"))
    joined = candidates.join(segments.groupBy("document_id").agg(F.collect_list(listed).alias("segs")), "document_id", "left")

    def met(s: Column) -> Column:
        fits = (s["scope"] == F.col("scope")) | (s["scope"] == "unknown") | (F.col("scope") == "unknown")
        meet = (s["start_page"] <= F.col("end_page")) & (F.col("start_page") <= s["end_page"])
        overlap = F.greatest(F.lit(0), F.least(s["end_page"], F.col("end_page")) - F.greatest(s["start_page"], F.col("start_page")) + 1)
        seg = F.struct(*[s[c].alias(c) for c in ("scope", "start_page", "end_page", "score", "reasons", "ord")])
        return F.when((s["statement_type"] == F.col("statement_type")) & fits & meet, F.struct(overlap.alias("overlap"), s["score"].alias("score"), (-s["ord"]).alias("early"), seg.alias("seg")))

    best = joined.withColumn("best", F.array_max(F.transform("segs", met)))
    return best.withColumns({"overlap": F.col("best.overlap"), "seg": F.col("best.seg"), "told": F.col("segs").isNotNull()}).drop("segs", "best")


def _first_of_candidate(rows: DataFrame, stays: Column | None = None) -> DataFrame:
    return first_wins(rows, ["document_id", "candidate_ord"], F.col("overlap").desc_nulls_last(), F.col("seg.score").desc(), "seg.ord", stays=stays)


def reconciled(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans narrowed to their best segment; a segment never widens one. Candidates without a match stay."""
    return ordered(first_of_equal(_narrowed(best_overlap(candidates, segments))))


def refined(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans narrowed to their best segment in documents that have any segment; those of other documents as they are."""
    stays = ~F.col("told")
    return ordered(first_of_equal(_narrowed(_first_of_candidate(_with_best(candidates, segments), stays)), stays), stays)


def _narrowed(joined: DataFrame) -> DataFrame:
    matched = F.col("seg").isNotNull()
    low, high = F.greatest("start_page", "seg.start_page"), F.least("end_page", "seg.end_page")
    scope = F.when(matched & (F.col("seg.scope") != "unknown"), F.col("seg.scope")).otherwise(F.col("scope"))
    reasons = F.when(matched, F.concat("reasons", "seg.reasons", F.array(F.lit("llm_range_clamped_to_heuristic")))).otherwise(F.col("reasons"))
    return joined.select("document_id", "include", scope.alias("scope"), "statement_type", F.when(matched & (low <= high), low).otherwise(F.col("start_page")).alias("start_page"), F.when(matched & (low <= high), high).otherwise(F.col("end_page")).alias("end_page"), F.when(matched, F.greatest("score", "seg.score")).otherwise(F.col("score")).alias("score"), reasons.alias("reasons"), F.col("candidate_ord").alias("found_ord"), "told")


def broad_range(documents: DataFrame, candidates: DataFrame, toc_checks: DataFrame) -> DataFrame:
    """Per document the pages worth sending to a model: all spans and statement-like contents entries, two pages wider; else 1 to 20."""
    from factloom.functions.text import WS

    title = F.regexp_replace("title", f"{WS}+", "")
    like = F.lit(False)
    for name in ("재무상태표", "손익계산서", "현금흐름표", "자본변동표"):
        like = like | title.contains(name)
    toc = toc_checks.where(like).select("document_id", F.coalesce("found_page", "expected_page").alias("a"), F.coalesce("found_page", "expected_page").alias("b"))
    ends = candidates.select("document_id", F.col("start_page").alias("a"), F.col("end_page").alias("b")).unionByName(toc).groupBy("document_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    joined = documents.join(ends, "document_id", "left")
    return joined.select("document_id", F.coalesce(F.greatest(F.lit(1), F.col("a") - 2), F.lit(1)).alias("start_page"), F.least(F.col("page_count"), F.coalesce(F.col("b") + 2, F.lit(20))).alias("end_page"))


def broad_pages(pages: DataFrame, ranges: DataFrame, max_pages: int = 100, max_chars: int = 12_000) -> DataFrame:
    """The first max_pages page numbers of each range, their texts cut at max_chars; this bounds a model request, nothing else."""
    limit = max_pages if max_pages else 80
    joined = pages.join(ranges, "document_id").where((F.col("page_number") >= F.col("start_page")) & (F.col("page_number") <= F.col("end_page")) & (F.col("page_number") < F.col("start_page") + limit))
    cut = F.when(F.length("text") > max_chars, F.concat(F.left("text", F.lit(max_chars)), F.lit("\n[TRUNCATED]"))).otherwise(F.col("text"))
    return joined.select("document_id", "page_number", cut.alias("text"))
