"""Facts from a model's table structure and from a model that reads page images.

The structure names cells only; every number is read from the page's own cells. responses(document_id, candidate_ord, response).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.amounts import amount, concept, unit_label
from factloom.functions.json import json_text
from factloom.functions.text import WS, let, rounded, text, trimmed

CANDIDATE = ["document_id", "candidate_ord"]
MAX_COLUMNS = 8


def structure_label(label: Column) -> Column:
    out = F.regexp_replace(text(label), rf"(?i)^[IVXLCDMⅠ-ⅿ]+(?:{WS}|[.)])+", "")
    out = F.regexp_replace(out, rf"^[①-⑳❶-❿]{WS}*", "")
    return trimmed(F.regexp_replace(out, f"{WS}+", " "))


OBJECT = "map<string,string>"


def _number(item: Column, name: str) -> Column:
    """A JSON number of a parsed object, or text that is one; JSON null and "" are 0, a missing key is null."""
    return let(F.try_element_at(item, F.lit(name)), lambda v: F.when((v.isNull() | (F.trim(v) == "")) & F.map_contains_key(item, name), F.lit(0.0)).otherwise(v.try_cast("double")))


def _notes(raw: Column) -> Column:
    return F.filter(F.transform(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), trimmed), lambda n: n != "")


def parsed(responses: DataFrame) -> DataFrame:
    """CANDIDATE, unit, columns, rows (an object each). A generator's columns are never written out where they are used, so an answer is parsed once."""

    def told(answer: Column) -> Column:
        # an answer whose rows are all objects is parsed with them; of others each row is parsed by itself, and what is no object is empty
        def by_row(doc: Column) -> Column:
            return F.struct(doc["unit"].alias("unit"), doc["columns"].alias("columns"), F.transform(doc["rows"], lambda r: F.coalesce(F.from_json(r, OBJECT), F.create_map().cast(OBJECT))).alias("rows"))

        apart = let(F.from_json(answer, "unit string, columns array<string>, rows array<string>"), by_row)
        at_once = F.from_json(answer, f"unit string, columns array<string>, rows array<{OBJECT}>")
        return let(at_once, lambda doc: F.when(F.forall(doc["rows"], lambda r: r.isNotNull()), doc).otherwise(apart))

    return responses.select(*CANDIDATE, F.inline_outer(F.array(let(json_text(F.col("response")), told))))


def _row(m: Column, row_pos: Column) -> Column:
    """A row of an answer: row_pos, order, label, notes, cells (map of column to JSON reference, null if there is none)."""
    get = lambda name: F.try_element_at(m, F.lit(name))
    return F.struct(row_pos.alias("row_pos"), F.coalesce(_number(m, "order"), F.lit(0.0)).alias("order"), structure_label(get("label")).alias("label"), _notes(get("notes")).alias("notes"), F.from_json(get("value_cells"), OBJECT).alias("cells"))


def structure_rows(responses: DataFrame) -> DataFrame:
    """CANDIDATE, row_pos, unit, order, label, notes, cells."""
    rows = parsed(responses).select(*CANDIDATE, unit_label(F.col("unit")).alias("unit"), F.inline(F.transform("rows", _row)))
    return rows.select(*CANDIDATE, "row_pos", "unit", "order", "label", "notes", "cells")


def key_order(key: Column, pos: Column) -> Column:
    """Object keys in the order in which they are enumerated: whole numbers first and ascending, then as they came."""
    whole = key.rlike(r"^(?:0|[1-9]\d{0,8})\z")
    return F.struct(F.when(whole, 0).otherwise(1).alias("other"), F.when(whole, key.try_cast("long")).otherwise(pos.cast("long")).alias("at"))


#: A reference as it is mostly written: page, row and cells as plain numbers (page and row also in quotes), in this order and nothing else.
_PLAIN_REFERENCE = r'^\{ *"page" *: *("?)(\d{1,9})\1 *, *"row_index" *: *("?)(\d{1,9})\3 *, *"cell_indices" *: *\[ *(\d{1,9}(?: *, *\d{1,9})*)? *\] *\}\z'


def _reference(ref: Column) -> Column:
    """page, row_index, cell_indices of a JSON reference; one that is written plainly is read without a parser."""

    def plain(r: Column) -> Column:
        part = lambda n: F.regexp_extract(r, _PLAIN_REFERENCE, n)
        cells = let(part(5), lambda c: F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ","), lambda i: F.trim(i).cast("int"))))
        return F.struct(part(2).cast("int").alias("page"), part(4).cast("int").alias("row_index"), cells.alias("cell_indices"))

    return let(ref, lambda r: F.when(r.rlike(_PLAIN_REFERENCE), plain(r)).otherwise(_parsed_reference(r)))


def _parsed_reference(ref: Column) -> Column:
    def shaped(m: Column) -> Column:
        raw = F.from_json(F.try_element_at(m, F.lit("cell_indices")), "array<string>")
        indices = F.transform(raw, lambda i: F.coalesce(F.when(F.trim(i) == "", 0.0), i.try_cast("double"), F.lit(0.0)).cast("int"))
        return F.struct(_number(m, "page").cast("int").alias("page"), _number(m, "row_index").cast("int").alias("row_index"), F.coalesce(indices, F.array().cast("array<int>")).alias("cell_indices"))

    return let(F.coalesce(F.from_json(ref, OBJECT), F.create_map().cast(OBJECT)), shaped)


def references(rows: DataFrame) -> DataFrame:
    """One row for each cell reference: CANDIDATE, row_pos, column_key, key_ord, page, row_index, cell_indices."""
    entries = rows.where("label != '' and cells is not null").select(*CANDIDATE, "row_pos", "label", F.posexplode("cells").alias("pos", "column_key", "ref"))
    return entries.select(*CANDIDATE, "row_pos", "label", "column_key", key_order(F.col("column_key"), F.col("pos")).alias("key_ord"), F.inline(F.array(_reference(F.col("ref")))))


def read_references(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """References with valid (all cells are there, and there is one), text (cells in the listed order, joined) and bounding box.

    References and cells meet by an equi-join on (document_id, page, row, cell); cells(document_id, page_number, row_index, cell_index,
    x, y, width, height, text).
    """
    keys = [*CANDIDATE, "row_pos", "column_key"]
    listed = refs.select(*keys, "page", "row_index", F.posexplode_outer("cell_indices").alias("pos", "cell_index"))
    return refs.join(_read(listed.join(_by_place(cells), ["document_id", "page", "row_index", "cell_index"], "left"), keys).select(*keys, "valid", "text", "bbox"), keys)


def _by_place(cells: DataFrame) -> DataFrame:
    return cells.withColumnRenamed("page_number", "page").select("document_id", "page", "row_index", "cell_index", F.struct("x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"), "text").alias("cell"))


def _read(found: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, valid, text, bbox of references that have met their cells. found(keys, pos, cell)."""
    there = F.col("cell").isNotNull()
    got = found.groupBy(*keys).agg(
        F.bool_and(there).alias("valid"),
        F.array_sort(F.collect_list(F.when(there, F.struct("pos", "cell.text")))).alias("parts"),
        F.min("cell.x").alias("x1"), F.min("cell.y").alias("y1"), F.max(F.col("cell.x") + F.col("cell.width")).alias("x2"), F.max(F.col("cell.y") + F.col("cell.height")).alias("y2"), *more,
    )
    box = F.when(F.col("x1").isNotNull(), F.array(*[rounded(F.col(c)) for c in ("x1", "y1", "x2", "y2")]))
    rest = [c for c in got.columns if c not in ("parts", "x1", "y1", "x2", "y2")]
    return got.select(*rest, trimmed(F.array_join(F.transform("parts", lambda p: p.text), "")).alias("text"), box.alias("bbox"))


def structure_warnings(rows: DataFrame, read: DataFrame) -> DataFrame:
    """CANDIDATE, row_pos, warning. The warnings are part of the result rows."""
    dropped = rows.where("label = '' or cells is null").select(*CANDIDATE, "row_pos", F.lit("Dropped row without label or value_cells.").alias("warning"))
    bad = read.where(~F.col("valid")).select(*CANDIDATE, "row_pos", F.concat(F.lit("Dropped invalid cell reference for "), F.col("label"), F.lit(" / "), F.col("column_key"), F.lit(".")).alias("warning"))
    return dropped.unionByName(bad)


def _listed_columns(columns: Column) -> Column:
    """The columns that a response lists, eight at most: [key, label]."""

    def column(c: Column) -> Column:
        key = trimmed(text(F.get_json_object(c, "$.key")))
        return F.struct(key.alias("key"), trimmed(F.coalesce(F.get_json_object(c, "$.label"), key)).alias("label"))

    return F.slice(F.filter(F.transform(F.coalesce(columns, F.array().cast("array<string>")), column), lambda c: c["key"] != ""), 1, MAX_COLUMNS)


def _cells_wanted(rows: Column) -> Column:
    """An element for each cell that the rows point to, and one without a cell for a reference to none: [row_pos, key, key_ord, page, row_index, pos, cell_index]."""

    def of_reference(row: Column, pos: Column, entry: Column) -> Column:
        def listed(ref: Column) -> Column:
            one = lambda at, cell: F.struct(row["row_pos"].alias("row_pos"), entry["key"].alias("key"), key_order(entry["key"], pos).alias("key_ord"), ref["page"].alias("page"), ref["row_index"].alias("row_index"), at.cast("int").alias("pos"), cell.cast("int").alias("cell_index"))
            return F.when(F.size(ref["cell_indices"]) > 0, F.transform(ref["cell_indices"], lambda c, k: one(k, c))).otherwise(F.array(one(F.lit(0), F.lit(None))))

        return let(_reference(entry["value"]), listed)

    pointing = F.filter(rows, lambda r: (r["label"] != "") & r["cells"].isNotNull())
    return F.flatten(F.transform(pointing, lambda r: F.flatten(F.transform(F.map_entries(r["cells"]), lambda e, k: of_reference(r, k, e)))))


def structure_facts(responses: DataFrame, cells: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of the rows that read anything, in the order of the rows; the first value that isn't empty counts.

    A response is parsed once. The cells that it points to go to meet the pages' cells, and the response itself goes with them as one more
    row, so that both come together again by candidate: no part of the plan is worked out twice. What one model answered meets in one row.
    """
    shaped = parsed(responses).select(*CANDIDATE, F.inline(F.array(F.struct(unit_label(F.col("unit")).alias("unit"), _listed_columns(F.col("columns")).alias("listed"), F.transform("rows", _row).alias("rows")))))
    told = F.struct("unit", "listed", F.transform("rows", lambda r: F.struct(r["row_pos"].alias("row_pos"), r["order"].alias("order"), r["label"].alias("label"), r["notes"].alias("notes"))).alias("rows"))
    itself = F.struct(F.lit(-1).alias("row_pos"), F.lit("").alias("key"), F.struct(F.lit(0).alias("other"), F.lit(0).cast("long").alias("at")).alias("key_ord"), *[F.lit(None).cast("int").alias(c) for c in ("page", "row_index", "pos", "cell_index")], told.alias("told"))
    kind = "struct<unit:string,listed:array<struct<key:string,label:string>>,rows:array<struct<row_pos:int,order:double,label:string,notes:array<string>>>>"
    wanted = F.transform(_cells_wanted(F.col("rows")), lambda w: F.struct(*[w[c].alias(c) for c in ("row_pos", "key", "key_ord", "page", "row_index", "pos", "cell_index")], F.lit(None).cast(kind).alias("told")))
    asked = shaped.where("rows is not null").select(*CANDIDATE, F.inline(F.concat(F.array(itself), wanted)))
    # what was found is dealt by document once, which serves both the references and the responses
    found = asked.join(_by_place(cells), ["document_id", "page", "row_index", "cell_index"], "left").repartition("document_id")
    read = _read(found, [*CANDIDATE, "row_pos", "key"], F.min("key_ord").alias("key_ord"), F.min("page").alias("page"), F.first("told", ignorenulls=True).alias("told"))
    good = F.when(F.col("valid"), F.struct("row_pos", "key_ord", "key", "page", "text", "bbox"))
    packed = read.groupBy(*CANDIDATE).agg(F.array_sort(F.collect_list(good)).alias("refs"), F.first("told", ignorenulls=True).alias("told"))
    packed = packed.where(F.size("refs") > 0).select(*CANDIDATE, "refs", "told.*")

    used = F.array_distinct(F.transform("refs", lambda r: r["key"]))
    columns = F.when(F.size("listed") > 0, F.filter("listed", lambda c: F.exists("refs", lambda r: r["key"] == c["key"]))).otherwise(F.transform(used, lambda k: F.struct(k.alias("key"), k.alias("label"))))

    def fact(row: Column) -> Column:
        def with_cells(own: Column) -> Column:
            def cell(c: Column, k: Column) -> Column:
                return let(F.get(F.filter(own, lambda r: r["key"] == c["key"]), F.lit(0)), lambda r: F.struct(k.alias("column_ord"), c["key"].alias("key"), c["label"].alias("column_label"), F.coalesce(r["text"], F.lit("")).alias("text"), r["page"].alias("page"), r["bbox"].alias("bbox")))

            return F.struct(row["order"].alias("order"), row["row_pos"].alias("row_pos"), row["label"].alias("label"), row["notes"].alias("notes"), F.when(F.size(own) > 0, F.transform("columns", cell)).alias("cells_read"))

        return let(F.filter("refs", lambda r: r["row_pos"] == row["row_pos"]), with_cells)

    # a row with no valid reference goes; every column of the candidate is then read for each row that stays
    facts = F.filter(F.transform("rows", fact), lambda f: F.coalesce(F.exists(f["cells_read"], lambda c: c["text"] != ""), F.lit(False)))
    each = packed.withColumn("columns", columns).select(*CANDIDATE, "unit", F.posexplode(F.array_sort(facts)).alias("row_ord", "f")).select(*CANDIDATE, "unit", "row_ord", "f.*")
    joined = each.join(candidates.select(*CANDIDATE, "scope", "statement_type", "start_page"), CANDIDATE).join(documents.select("document_id", "filename"), "document_id", "left")
    values = F.transform("cells_read", lambda c: c.text)
    first = F.get(F.filter(values, lambda v: v != ""), F.lit(0))
    # the evidence is enumerated like an object's keys
    on_page = F.array_min(F.transform(F.filter("cells_read", lambda c: c.page.isNotNull()), lambda c: F.struct(key_order(c["key"], c["column_ord"]).alias("place"), c["page"].alias("page"))))["page"]
    labels = F.transform("cells_read", lambda c: F.when(c.column_label != "", c.column_label).otherwise(c.key))
    return joined.select(
        *CANDIDATE, "filename", "scope", "statement_type", concept(F.col("label")).alias("concept"), "label", F.get(F.transform("cells_read", lambda c: c.key), F.lit(0)).alias("period"),
        amount(first, F.col("unit")).alias("value"), "unit", F.coalesce(on_page, "start_page").alias("page_number"), F.lit(0.88).alias("confidence"), F.lit("").alias("raw_line"),
        values.alias("all_values"), F.transform("cells_read", lambda c: c.key).alias("period_labels"), labels.alias("column_labels"), "notes", F.to_json(F.map_from_entries(F.transform("cells_read", lambda c: F.struct(c.key, F.struct(c.page.alias("page"), c.text.alias("text"), c.bbox.alias("bbox")))))).alias("evidence"), F.col("row_ord").cast("int").alias("row_ord"),
    )


def vision_facts(responses: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of rows that a model read from page images: rows with a label and any value besides "" and "-"."""
    columns = F.filter(F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.struct(F.get_json_object(c, "$.key").alias("key"), F.get_json_object(c, "$.label").alias("label"))), lambda c: F.coalesce(c.key, F.lit("")) != "")
    doc = parsed(responses).select(*CANDIDATE, "rows", F.inline(F.array(F.struct(unit_label(F.col("unit")).alias("unit"), columns.alias("columns")))))

    def row(m: Column) -> Column:
        """label, all_values by the columns, notes, depth."""
        get = lambda name: F.try_element_at(m, F.lit(name))
        values = let(F.coalesce(F.from_json(get("values"), OBJECT), F.create_map().cast(OBJECT)), lambda shown: F.transform("columns", lambda c: F.coalesce(F.try_element_at(shown, c["key"]), F.lit(""))))
        notes = F.filter(F.coalesce(F.from_json(get("notes"), "array<string>"), F.array().cast("array<string>")), lambda n: n != "")
        return F.struct(trimmed(text(get("label"))).alias("label"), values.alias("all_values"), notes.alias("notes"), F.coalesce(_number(m, "depth"), F.lit(0.0)).cast("int").alias("depth"))

    shown = F.filter(F.transform("rows", row), lambda r: (r["label"] != "") & F.exists(r["all_values"], lambda v: ~v.isin("", "-")))
    rows = doc.select(*CANDIDATE, "unit", "columns", F.posexplode(shown).alias("row_ord", "r")).select(*CANDIDATE, "unit", "columns", "row_ord", "r.*")
    joined = rows.join(candidates.select(*CANDIDATE, "scope", "statement_type", "start_page"), CANDIDATE).join(documents.select("document_id", "filename"), "document_id", "left")
    first = F.get(F.filter("all_values", lambda v: v != ""), F.lit(0))
    keys = F.transform("columns", lambda c: c.key)
    return joined.select(
        *CANDIDATE, "filename", "scope", "statement_type", concept(F.col("label")).alias("concept"), "label", F.coalesce(F.get(keys, F.lit(0)), F.lit("")).alias("period"),
        amount(first, F.col("unit")).alias("value"), "unit", F.col("start_page").alias("page_number"), F.lit(0.92).alias("confidence"), F.lit("").alias("raw_line"),
        "all_values", keys.alias("period_labels"), F.transform("columns", lambda c: F.when(F.coalesce(c.label, F.lit("")) != "", c.label).otherwise(c.key)).alias("column_labels"), "notes",
        F.to_json(F.struct(F.lit("vision").alias("source"), "depth")).alias("evidence"), F.col("row_ord").cast("int").alias("row_ord"),
    )
