"""Structure review: what kind of report a document is, its table of contents, and which expected parts are missing.

pages(document_id, page_number, text), documents(document_id, page_count). A document is gone through once: windows over its pages find
the contents pages and hand their entries (120 at most) to every page, each page tells which entries and sections it has, and the
best page of each is a small aggregate. All of it is dealt by document_id, so it costs one shuffle of the pages; what comes out is one row a document, and every table of the review is read from that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import WS, compact, let, lines, trimmed
from factloom.functions.vocabulary import REPORT_PATTERNS, REQUIRED_SECTIONS, STANDALONE_TITLES

FIRST_PAGES, CONTENTS_PAGES, MAX_ENTRIES, REACH = 12, 20, 120, 5
SECTIONS = sorted({name for names in REQUIRED_SECTIONS.values() for name in names})


def _ranked(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_number", "text").withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy("page_number")))


def report_types(pages: DataFrame) -> DataFrame:
    """document_id, report_type, confidence, type_reasons: by how many patterns the first twelve pages hold; a tie is an annual report."""
    first = _ranked(pages).where(F.col("nth") <= FIRST_PAGES).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("first"))
    return first.select("document_id", compact(F.array_join(F.transform("first", lambda p: p.text), "\n")).alias("head")).transform(_typed).drop("head")


def _typed(documents: DataFrame) -> DataFrame:
    """documents with the kind of report that their head (the compact text of the first pages) tells."""

    def found(kind: str) -> Column:
        return F.filter(F.array(*[F.when(F.col("head").contains("".join(p.split())), F.lit(p)) for p in REPORT_PATTERNS[kind]]), lambda p: p.isNotNull())

    scored = documents.withColumns({"annual": found("annual_report"), "audit": found("audit_report")})
    annual, audit = F.size("annual"), F.size("audit")
    best = F.when((annual == 0) & (audit == 0), "unknown").when(annual >= audit, "annual_report").otherwise("audit_report")
    count = F.greatest(annual, audit)
    reasons = F.when(best == "annual_report", F.col("annual")).when(best == "audit_report", F.col("audit")).otherwise(F.array().cast("array<string>"))
    told = {"report_type": best, "confidence": F.when(count == 0, 0.0).otherwise(F.least(F.lit(0.95), F.lit(0.45) + count * F.lit(0.2))), "type_reasons": reasons}
    return scored.withColumns(told).drop("annual", "audit")


def page_references(page_text: Column) -> Column:
    """Lines that end in a number and are longer than three characters."""
    return F.size(F.filter(lines(page_text), lambda line: let(trimmed(line), lambda t: F.right(t, F.lit(1)).between("0", "9") & (F.length(t) > 3))))


def clean_contents_title(title: Column) -> Column:
    out = F.regexp_replace(title, rf"(?i)^[IVXLCDMⅠ-ⅿ\d]+(?:{WS}|[.)-])*", "")
    out = F.regexp_replace(out, rf"^[①-⑳❶-❿]{WS}*", "")
    out = F.regexp_replace(out, rf"(?:{WS}|[-–—.])+\z", "")
    return trimmed(out)


def contents_lines(page_number: Column, page_text: Column) -> Column:
    """The lines of title and page number of a contents page: [page_number, line_index, title, title_key, expected_page]."""
    pattern = r"(?s)^(.{2,100}?)(?:\.{2,}|\s{2,}|\s)\s*(\d{1,4})\z"
    told = F.transform(lines(page_text), lambda raw, k: F.struct(k.alias("line_index"), trimmed(F.regexp_replace(raw, f"{WS}+", " ")).alias("line")))
    told = F.filter(told, lambda t: (t.line != "") & (compact(t.line) != "목차") & t.line.rlike(pattern))
    told = F.transform(told, lambda t: F.struct(t.line_index.alias("line_index"), clean_contents_title(F.regexp_extract(t.line, pattern, 1)).alias("title"), F.regexp_extract(t.line, pattern, 2).cast("int").alias("expected_page")))
    return F.transform(F.filter(told, lambda t: t.title != ""), lambda t: F.struct(page_number.alias("page_number"), t.line_index.alias("line_index"), t.title.alias("title"), compact(t.title).alias("title_key"), t.expected_page.alias("expected_page")))


def _numbered_entries(found: Column) -> Column:
    """The first of equal lines, in their order, 120 at most, with their words: [entry_ord, title, title_key, expected_page, words, joined]."""

    def first_of_equal(rows: Column) -> Column:
        keys = F.transform(rows, lambda e: F.struct(e.title_key.alias("k"), e.expected_page.alias("p")))
        return let(keys, lambda ks: F.filter(rows, lambda e, n: F.array_position(ks, F.struct(e.title_key.alias("k"), e.expected_page.alias("p"))) == n + 1))

    def entry(e: Column, n: Column) -> Column:
        words = F.slice(F.filter(F.split(e.title_key, r"[.()/\-\d]+"), lambda t: F.length(t) >= 2), 1, 4)
        return F.struct(n.alias("entry_ord"), e.title.alias("title"), e.title_key.alias("title_key"), e.expected_page.alias("expected_page"), words.alias("words"), F.array_join(words, "").alias("joined"))

    return F.transform(F.slice(let(F.array_sort(found), first_of_equal), 1, MAX_ENTRIES), entry)


def page_features(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, page_number, nth, text, compact_text, toc_page, confidence, in_toc, entries: each page with its document's contents.

    head: on the first page the compact text of the first twelve, by which the kind of report is told.

    The contents begin on the best scored of the first twenty pages, if it scores 20 or more, and go on over up to two page numbers after
    it while these have three references or more; page numbers that the document lacks are skipped.
    """
    document = W.partitionBy("document_id")
    # text is compacted behind the shuffle, so that it is shuffled once
    seen = _ranked(pages).withColumns({"compact_text": compact(F.col("text")), "refs": page_references(F.col("text"))}).join(documents.select("document_id", "page_count"), "document_id", "left")
    score = F.when(F.col("compact_text").contains("목차") | F.col("compact_text").contains("contents"), 50).otherwise(0) + F.least(F.lit(50), 5 * F.col("refs"))
    best = F.max(F.when(F.col("nth") <= CONTENTS_PAGES, F.struct(score.alias("score"), (-F.col("nth")).alias("early"), F.col("page_number").alias("page_number")))).over(document)
    start = F.when((F.col("best.score") >= 20) & F.col("page_count").isNotNull(), F.col("best.page_number"))
    near = seen.withColumn("best", best).withColumn("toc_page", start).withColumn("near", F.coalesce(F.col("page_number").between(F.col("toc_page"), F.least(F.col("page_count"), F.col("toc_page") + 2)), F.lit(False)))
    stop = F.min(F.when(F.col("near") & (F.col("page_number") != F.col("toc_page")) & (F.col("refs") < 3), F.col("page_number"))).over(document)
    placed = near.withColumn("stop", stop).withColumn("in_toc", F.col("near") & (F.col("stop").isNull() | (F.col("page_number") < F.col("stop"))))
    own = placed.withColumn("own", F.when(F.col("in_toc"), contents_lines(F.col("page_number"), F.col("text"))))
    # the lines of all contents pages are put in order on one page, which hands them to the others
    early = F.collect_list(F.when(F.col("nth") <= FIRST_PAGES, F.struct("nth", "compact_text"))).over(document)
    gathered = own.withColumn("all", F.flatten(F.collect_list("own").over(document))).withColumn("early", early)
    head = F.array_join(F.transform(F.array_sort("early"), lambda p: p["compact_text"]), "")
    first = gathered.withColumns({"first_entries": F.when(F.col("nth") == 1, _numbered_entries(F.col("all"))), "head": F.when(F.col("nth") == 1, head)})
    entries = first.withColumn("entries", F.max_by("first_entries", -F.col("nth")).over(document))
    return entries.select("document_id", "page_number", "nth", "text", "compact_text", "toc_page", F.least(F.lit(0.95), F.col("best.score") / F.lit(100.0)).alias("confidence"), "in_toc", "entries", "head")


def contents_pages(features: DataFrame) -> DataFrame:
    """document_id, toc_page, confidence, page_number, text: the pages of the table of contents."""
    return features.where("in_toc").select("document_id", "toc_page", "confidence", "page_number", "text")


def contents_entries(features: DataFrame) -> DataFrame:
    """document_id, entry_ord, title, title_key, expected_page: the entries of the table of contents."""
    return features.where("nth = 1").select("document_id", F.explode("entries").alias("e")).select("document_id", "e.entry_ord", "e.title", "e.title_key", "e.expected_page")


def own_lines(page_text: Column) -> Column:
    """The lines that may be a statement's title; those without the last letter of one are done with one look."""
    named = F.filter(lines(page_text), lambda line: line.contains("표") | line.contains("서"))
    return F.filter(F.transform(named, lambda line: F.regexp_replace(compact(line), r"^\d+(?:-\d+)?\.", "")), lambda c: ~c.contains("주석") & (F.length(c) <= 40))


def section_is_on(needle: Column | str) -> Column:
    """Is the (compact) section name on the searchable page? Statement titles need a line of their own."""
    known = isinstance(needle, str)
    name = F.lit(needle) if known else needle
    variants = F.array(*[F.lit(prefix + needle) if known else F.concat(F.lit(prefix), needle) for prefix in ("", "연결", "개별", "별도", "포괄", "연결포괄")])
    alone, within = (F.size("own_lines") > 0) & F.arrays_overlap("own_lines", variants), F.col("compact_text").contains(name)
    if known:
        return alone if needle in STANDALONE_TITLES else within
    return F.when(needle.isin(STANDALONE_TITLES), alone).otherwise(within)


#: A page's rank for an entry or section as one number: tier, then nearness, then page number; the least is the best.
_TIER, _NEAR = 1 << 48, 1 << 40


def _page_of(rank: Column) -> Column:
    return (rank % _NEAR).cast("int")


def entry_rank(e: Column) -> Column:
    """How good the page is for a contents entry, null if it isn't on it.

    A page within five of the expected one comes first, the nearest (the later of two equally near) before others; then the first page
    with the title; then the first with the title's words joined.
    """
    page = F.col("page_number").cast("long")
    off = page - e["expected_page"]
    by_title = (e["title_key"] != "") & section_is_on(e["title_key"])
    # words that make up the title itself say what the title said
    by_words = (F.size(e["words"]) > 0) & (e["joined"] != e["title_key"]) & section_is_on(e["joined"]) & F.forall(e["words"], lambda w: F.col("compact_text").contains(w))
    titled = F.when(F.abs(off) <= REACH, (F.abs(off) * 2 + F.when(off > 0, 0).otherwise(1)) * _NEAR + page).otherwise(_TIER + page)
    return F.when(by_title, titled).when(by_words, 2 * _TIER + page)


def reviewed(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a document: report_type, confidence, type_reasons, has_toc, sections [section_ord, section, found_page], checks [entry_ord,
    title, expected_page, found_page, status], issues [issue_ord, severity, message], status."""
    features = page_features(pages, documents)
    searched = features.withColumn("own_lines", F.when(~F.col("in_toc"), own_lines(F.col("text"))))

    def told(kind: str, ord_: Column, rank: Column, info: Column | None = None) -> Column:
        nothing = F.lit(None).cast("struct<entries:array<struct<entry_ord:int,title:string,title_key:string,expected_page:int,words:array<string>,joined:string>>,head:string>")
        return F.struct(F.lit(kind).alias("kind"), ord_.cast("int").alias("ord"), rank.cast("long").alias("rank"), (nothing if info is None else info).alias("info"))

    on_page = F.filter(F.transform("entries", lambda e: told("entry", e["entry_ord"], entry_rank(e))), lambda t: t["rank"].isNotNull())
    names = F.array_compact(F.array(*[F.when(section_is_on(name), told("section", F.lit(n), F.col("page_number"))) for n, name in enumerate(SECTIONS)]))
    contents = F.when(F.col("in_toc"), F.array(told("contents", F.lit(0), F.col("page_number")))).otherwise(F.concat(on_page, names))
    first = F.when(F.col("nth") == 1, F.array(told("document", F.lit(0), F.lit(0), F.struct("entries", "head")))).otherwise(F.array().cast("array<struct<kind:string,ord:int,rank:bigint,info:struct<entries:array<struct<entry_ord:int,title:string,title_key:string,expected_page:int,words:array<string>,joined:string>>,head:string>>>"))
    tellings = searched.select("document_id", F.explode(F.concat(first, contents)).alias("t")).select("document_id", "t.*")
    best = tellings.groupBy("document_id", "kind", "ord").agg(F.min("rank").alias("rank"), F.first("info", ignorenulls=True).alias("info"))
    places = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "rank"))))
    met = best.groupBy("document_id").agg(F.first("info", ignorenulls=True).alias("info"), places("entry").alias("on_pages"), places("section").alias("has_sections"), F.bool_or(F.col("kind") == "contents").alias("has_toc"))
    return _judged(_typed(met.withColumn("head", F.col("info.head"))))


def _judged(documents: DataFrame) -> DataFrame:
    def check(e: Column) -> Column:
        found = _page_of(F.try_element_at("on_pages", e["entry_ord"]))
        apart = F.abs(found - e["expected_page"])
        status = F.when(found.isNull(), "missing").when(apart == 0, "matched").when(apart <= 2, "near").otherwise("page_mismatch")
        return F.struct(e["entry_ord"].alias("entry_ord"), e["title"].alias("title"), e["expected_page"].alias("expected_page"), found.alias("found_page"), status.alias("status"))

    expected = F.create_map(*[x for kind, names in REQUIRED_SECTIONS.items() for x in (F.lit(kind), F.array(*[F.struct(F.lit(n).alias("section_ord"), F.lit(name).alias("section"), F.lit(SECTIONS.index(name)).alias("place")) for n, name in enumerate(names)]))])
    nothing = F.array().cast("array<struct<section_ord:int,section:string,place:int>>")
    sections = F.transform(F.coalesce(F.try_element_at(expected, F.col("report_type")), nothing), lambda s: F.struct(s["section_ord"].alias("section_ord"), s["section"].alias("section"), _page_of(F.try_element_at("has_sections", s["place"])).alias("found_page")))
    rows = documents.withColumns({"checks": F.transform("info.entries", check), "sections": sections})

    def issue(step: int, ord_: Column, severity: str, message: Column) -> Column:
        return F.struct(F.struct(F.lit(step).alias("step"), ord_.cast("long").alias("ord")).alias("issue_ord"), F.lit(severity).alias("severity"), message.alias("message"))

    none, zero = F.array().cast("array<struct<issue_ord:struct<step:int,ord:bigint>,severity:string,message:string>>"), F.lit(0)
    only = lambda condition, i: F.when(condition, F.array(i)).otherwise(none)
    # The messages are part of the result rows.
    issues = F.concat(
        only(F.col("report_type") == "unknown", issue(0, zero, "high", F.lit("Document type could not be identified as audit report or annual report."))),
        only(~F.col("has_toc"), issue(1, zero, "medium", F.lit("No table of contents was detected in the first 20 pages."))),
        only(F.col("has_toc") & (F.size("checks") == 0), issue(1, zero, "medium", F.lit("A table of contents page was detected, but structured entries could not be parsed."))),
        F.transform(F.filter("sections", lambda s: s["found_page"].isNull()), lambda s: issue(2, s["section_ord"], "medium", F.concat(F.lit("Expected section not found: "), s["section"]))),
        F.transform(failed_entries(F.col("checks"), 20), lambda c: issue(3, c["entry_ord"], "low", F.concat(F.lit("TOC entry check failed: "), c["title"]))),
    )
    worst = F.when(F.exists("issues", lambda i: i["severity"] == "high"), "error").when(F.size("issues") > 0, "warn").otherwise("ok")
    return rows.withColumn("issues", issues).withColumn("status", worst).select("document_id", "report_type", "confidence", "type_reasons", "has_toc", "sections", "checks", "issues", "status")


def failed_entries(checks: Column, limit: int = 50) -> Column:
    """The first entries that were not found where they should be."""
    return F.slice(F.filter(checks, lambda c: c["status"].isin("missing", "page_mismatch")), 1, limit)


def _each(documents: DataFrame, array: str) -> DataFrame:
    return documents.select("document_id", F.explode(array).alias("x")).select("document_id", "x.*")


def section_checks(documents: DataFrame) -> DataFrame:
    """document_id, section_ord, section, found_page: the first searchable page with each expected section, null without one. documents: reviewed()."""
    return _each(documents, "sections")


def contents_checks(documents: DataFrame) -> DataFrame:
    """document_id, entry_ord, title, expected_page, found_page, status. documents: reviewed()."""
    return _each(documents, "checks")


def review_issues(documents: DataFrame) -> DataFrame:
    """document_id, issue_ord, severity, message. documents: reviewed()."""
    return _each(documents, "issues")


def review(pages: DataFrame, documents: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """The whole review as named tables. folder: where the documents' rows are written, so that all tables are read from there."""
    rows = reviewed(pages, documents)
    if folder:
        rows.write.mode("overwrite").parquet(folder)
        rows = pages.sparkSession.read.schema(rows.schema).parquet(folder)
    features = page_features(pages, documents)
    return {"reviews": rows.select("document_id", "report_type", "confidence", "type_reasons"), "toc_pages": contents_pages(features), "toc_entries": contents_entries(features), "section_checks": section_checks(rows), "toc_checks": contents_checks(rows), "review_issues": review_issues(rows), "status": rows.select("document_id", "status"), "documents": rows}
