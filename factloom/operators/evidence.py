"""Table evidence: what kind each row of a page is, and which value column a numeric cell lies in.

span_pages(document_id, candidate_ord, page_number, item_rows) -> one row a page: row_count, numeric_row_count, rows[...].
Column bands are found over all pages of a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import COMMA_NUMBER, first_or_null, let, rounded, text, trimmed, unspaced

MAX_ROWS, MAX_CELLS, HEADER_ROWS, MAX_BANDS = 140, 18, 30, 6
#: Farther than this from a cluster's mean, a center opens the next cluster.
CLUSTER_GAP = 12.0
CANDIDATE = ["document_id", "candidate_ord"]


def is_numeric_cell(value: Column) -> Column:
    return _is_number(trimmed(text(value)))


def _is_number(trimmed_text: Column) -> Column:
    return trimmed_text.rlike(rf"^(?:-|\(?\d+(?:\.\d+)?\)?|{COMMA_NUMBER})\z")


def row_kind(row_text: Column, numeric_cells: Column) -> Column:
    def told(c: Column) -> Column:
        title = c.rlike(r"^(?:연결|개별|별도)?(?:포괄)?(?:재무상태표|손익계산서|현금흐름표|자본변동표)\z")
        return F.when(title, "title").when(c.contains("단위") | c.rlike(r"20\d{2}|제\d+"), "header").when(numeric_cells > 0, "data").otherwise("text")

    return let(unspaced(text(row_text)), told)


def period_key(cell_text: Column) -> Column:
    """The period that a header cell names: a year, prior_2, prior or current; else null."""

    def told(c: Column) -> Column:
        year = F.when(c.contains("20"), first_or_null(F.regexp_extract(c, r"20\d{2}", 0)))
        named = F.when(c.contains("전전기"), "prior_2").when(c.contains("전기") | c.rlike(r"제\d+\(?전\)?기"), "prior").when(c.contains("당기") | c.rlike(r"제\d+\(?당\)?기"), "current")
        # most cells hold neither a year nor the last letter of a period's name, and are done with two looks
        return F.coalesce(year, F.when(c.contains("기"), named))

    return let(unspaced(text(cell_text)), told)


def normal_rows(item_rows: Column) -> Column:
    """Rows with at most 18 cells each, rounded, with text, count of numeric cells and kind; the first 140 that aren't empty.

    Whether a cell is numeric is told once, with its text.
    """

    def cell(c: Column) -> Column:
        return let(trimmed(text(c.text)), lambda t: F.struct(c.cell_index.alias("cell_index"), rounded(c.x).alias("x"), rounded(c.y).alias("y"), rounded(c.width).alias("width"), rounded(c.height).alias("height"), t.alias("text"), _is_number(t).alias("numeric")))

    def with_cells(r: Column) -> Column:
        return F.struct(r.row_index.alias("row_index"), rounded(r.y).alias("y"), F.transform(F.slice(r.cells, 1, MAX_CELLS), cell).alias("cells"))

    def with_text(r: Column) -> Column:
        joined = F.array_join(F.filter(F.transform(r.cells, lambda c: c.text), lambda t: t != ""), " ")
        return F.struct(r.row_index.alias("row_index"), r.y.alias("y"), F.size(F.filter(r.cells, lambda c: c.numeric)).alias("numeric_cell_count"), joined.alias("text"), r.cells.alias("cells"))

    def with_kind(r: Column) -> Column:
        return F.struct(r.row_index.alias("row_index"), r.y.alias("y"), row_kind(r.text, r.numeric_cell_count).alias("kind"), r.numeric_cell_count.alias("numeric_cell_count"), r.text.alias("text"), r.cells.alias("cells"))

    filled = F.filter(F.transform(F.transform(item_rows, with_cells), with_text), lambda r: (r.text != "") | (F.size(r.cells) > 0))
    return F.transform(F.slice(filled, 1, MAX_ROWS), with_kind)


def evidence_pages(span_pages: DataFrame) -> DataFrame:
    pages = span_pages.select(*CANDIDATE, "page_number", normal_rows(F.col("item_rows")).alias("rows"))
    return pages.select(*CANDIDATE, "page_number", F.size("rows").alias("row_count"), F.size(F.filter("rows", lambda r: r.kind == "data")).alias("numeric_row_count"), "rows")


def page_features(page_number: Column, rows: Column) -> Column:
    """What a page tells of its candidate's columns: headers [seen, key, label, center, width], the cells of its first 30 rows that name a
    period, and centers, those of the numeric cells of its data rows."""

    def header(r: Column, row_pos: Column) -> Column:
        def named(c: Column, k: Column) -> Column:
            seen = F.struct(page_number.alias("page_number"), row_pos.alias("row_pos"), k.alias("cell_pos"))
            return let(period_key(c.text), lambda key: F.when(key.isNotNull(), F.struct(seen.alias("seen"), key.alias("key"), c.text.alias("label"), (c.x + c.width / 2).alias("center"), c.width.alias("width"))))

        # a number without a year's first two digits is done with one look
        return F.array_compact(F.transform(r.cells, lambda c, k: F.when(~c.numeric | c.text.contains("20"), named(c, k))))

    headers = F.flatten(F.transform(F.slice(rows, 1, HEADER_ROWS), header))
    centers = F.flatten(F.transform(F.filter(rows, lambda r: r.kind == "data"), lambda r: F.transform(F.filter(r.cells, lambda c: c.numeric), lambda c: c.x + c.width / 2)))
    return F.struct(headers.alias("headers"), centers.alias("centers"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values)


def header_centers(headers: Column) -> Column:
    """One center for each period: mean place, mean width of 30 or more, first label. [center, seen, key, label, width]."""

    def one(key: Column) -> Column:
        def told(own: Column) -> Column:
            first = F.array_min(F.transform(own, lambda h: F.struct(h.seen.alias("seen"), h.label.alias("label"))))
            return F.struct(_mean(F.transform(own, lambda h: h.center)).alias("center"), first.seen.alias("seen"), key.alias("key"), first.label.alias("label"), F.greatest(F.lit(30.0), _mean(F.transform(own, lambda h: h.width))).alias("width"))

        return let(F.filter(headers, lambda h: h.key == key), told)

    return F.transform(F.array_distinct(F.transform(headers, lambda h: h.key)), one)


def clusters(values: Column, gap: float = CLUSTER_GAP) -> Column:
    """Means of clusters of the sorted values; each value is held against the mean of the last cluster so far. A fold that copies no
    list but where a cluster ends."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("means"))

    def step(s: Column, v: Column) -> Column:
        near = (s["n"] > 0) & (F.abs(s["total"] / s["n"] - v) <= gap)
        opened = F.struct(v.alias("total"), F.lit(1).alias("n"), F.when(s["n"] > 0, F.concat(s["means"], F.array(s["total"] / s["n"]))).otherwise(s["means"]).alias("means"))
        return F.when(near, F.struct((s["total"] + v).alias("total"), (s["n"] + 1).alias("n"), s["means"].alias("means"))).otherwise(opened)

    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.aggregate(F.sort_array(finite), start, step, lambda s: F.when(s["n"] > 0, F.concat(s["means"], F.array(s["total"] / s["n"]))).otherwise(s["means"]))


def numeric_centers(centers: Column) -> Column:
    """One center for each cluster of the numeric cells, the last six. [center, seen, key, label, width]."""

    def one(center: Column, i: Column) -> Column:
        key = F.concat(F.lit("period_"), i + 1)
        return F.struct(center.alias("center"), F.struct(i.alias("page_number"), F.lit(0).alias("row_pos"), F.lit(0).alias("cell_pos")).alias("seen"), key.alias("key"), key.alias("label"), F.lit(40.0).alias("width"))

    return let(clusters(centers), lambda means: F.transform(F.slice(means, F.greatest(F.size(means) - (MAX_BANDS - 1), F.lit(1)), F.lit(MAX_BANDS)), one))


def bands_of(centers: Column) -> Column:
    """Centers as bands that meet halfway, the outer ones open by 40 or one and a half widths; the last six by center."""

    def banded(kept: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            before, after, edge = F.get(kept, i - 1).center, F.get(kept, i + 1).center, F.greatest(F.lit(40.0), b.width * 1.5)
            x1 = F.when(i == 0, b.center - edge).otherwise((before + b.center) / 2)
            x2 = F.when(i == F.size(kept) - 1, b.center + edge).otherwise((b.center + after) / 2)
            return F.struct(i.alias("band_ord"), b.key.alias("key"), b.label.alias("label"), rounded(x1).alias("x1"), rounded(x2).alias("x2"), rounded(b.center).alias("center"))

        return F.transform(kept, one)

    last_six = lambda c: F.slice(c, F.greatest(F.size(c) - (MAX_BANDS - 1), F.lit(1)), F.lit(MAX_BANDS))
    return let(let(F.array_sort(centers), last_six), banded)


def annotated(pages: DataFrame, alone: bool = False) -> DataFrame:
    """Each page of evidence_pages() with its candidate's column_bands - of the periods in its headers, or, where it has none, of its
    numeric cells; numeric cells get the first band that their center lies in as value_column.

    A candidate's pages (few) meet in a window; only what they tell of columns is gathered, and the bands are worked out on one of them.
    alone: the caller knows that each candidate has one page, which tells all there is; nothing is shuffled or gathered then.
    """
    told = pages.withColumn("told", page_features(F.col("page_number"), F.col("rows")))
    if alone:
        placed = told.withColumn("column_bands", let(F.col("told"), _found_bands))
    else:
        candidate = W.partitionBy(*CANDIDATE)
        all_told = F.struct(*[F.flatten(F.collect_list(f"told.{c}").over(candidate)).alias(c) for c in ("headers", "centers")])
        gathered = told.withColumns({"all_told": all_told, "nth": F.row_number().over(candidate.orderBy("page_number"))})
        placed = gathered.withColumn("own_bands", F.when(F.col("nth") == 1, let(F.col("all_told"), _found_bands))).withColumn("column_bands", F.max_by("own_bands", -F.col("nth")).over(candidate))

    def cell(c: Column, bands: Column) -> Column:
        center = c.x + c.width / 2
        band = F.get(F.filter(bands, lambda b: center.between(b.x1, b.x2)), F.lit(0))
        return F.struct(c.cell_index.alias("cell_index"), c.x.alias("x"), c.y.alias("y"), c.width.alias("width"), c.height.alias("height"), c.text.alias("text"), F.when(c.numeric, band.key).alias("value_column"))

    def row(r: Column, bands: Column) -> Column:
        return F.struct(r.row_index.alias("row_index"), r.y.alias("y"), r.kind.alias("kind"), r.numeric_cell_count.alias("numeric_cell_count"), r.text.alias("text"), F.transform(r.cells, lambda c: cell(c, bands)).alias("cells"))

    # bound first: a column that only a lambda names is written out there, and worked out for each cell
    rows = let(F.col("column_bands"), lambda bands: F.transform("rows", lambda r: row(r, bands)))
    return placed.select(*pages.columns, "column_bands").withColumn("rows", rows)


def _found_bands(told: Column) -> Column:
    return bands_of(F.when(F.size(told["headers"]) > 0, header_centers(told["headers"])).otherwise(numeric_centers(told["centers"])))


def header_means(cells: DataFrame) -> DataFrame:
    """header_centers() over rows (document_id, candidate_ord, seen, key, label, center, width), for candidates of any number of header cells."""
    return cells.groupBy(*CANDIDATE, "key").agg(F.min_by("label", "seen").alias("label"), F.avg("center").alias("center"), F.greatest(F.lit(30.0), F.avg("width")).alias("width"), F.min("seen").alias("seen"))


def in_bands(cells: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, x, width) with the first band of their key that their center lies in. centers(keys, center, seen, key, label, width): few a key.

    A key has six bands at most, so they travel as one array: an equi-join on the key, and the interval is looked up in the array.
    """
    listed = centers.groupBy(*keys).agg(F.collect_list(F.struct("center", "seen", "key", "label", "width")).alias("centers")).select(*keys, bands_of(F.col("centers")).alias("bands"))
    center = F.col("x") + F.col("width") / 2
    joined = cells.join(listed, keys, "left")
    return joined.withColumn("value_column", F.get(F.filter("bands", lambda b: center.between(b.x1, b.x2)), F.lit(0)).key).drop("bands")
