"""Positioned text items as rows, cells, lines and page texts.

items(document_id, page_number, item_ord, str, x, y, width, height) -> cells(document_id, page_number, row_index, row_y, cell_index, x,
y, width, height, text) and pages(document_id, page_number, text).

Which row an item belongs to depends on the rows that items before it have opened, so a page is gone through in order, in Arrow batches
of pages: three look-ups an item, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import trimmed

#: An item belongs to a row whose first item is less than this away.
ROW_GAP = 3.0
PLACES = ("x", "y", "width", "height")
_ROWS = "document_id {id}, page_number {page}, item_rows array<struct<row_index:int,y:double,cells:array<struct<cell_index:int,x:double,y:double,width:double,height:double,text:string>>>>"


def first_fit(ys: list[float], gap: float = ROW_GAP) -> tuple[list[int], list[float]]:
    """(row of each y, first y of each row): the earliest row whose first y is less than gap away, else a new one.

    First ys lie in a grid of cells as wide as the gap, so those that can be near are in the y's own cell and the two beside it.
    """
    grid: dict[int, list[int]] = {}
    rows, firsts = [], []
    for y in ys:
        if not math.isfinite(y):  # near nothing, itself included
            rows.append(len(firsts))
            firsts.append(y)
            continue
        cell = math.floor(y / gap)
        near = [n for c in (cell - 1, cell, cell + 1) for n in grid.get(c, ()) if abs(firsts[n] - y) < gap]
        if near:
            rows.append(min(near))
        else:
            grid.setdefault(cell, []).append(len(firsts))
            rows.append(len(firsts))
            firsts.append(y)
    return rows, firsts


def _shaped(batch: pa.RecordBatch, gap: float, kind: pa.DataType) -> pa.RecordBatch:
    """Pages with item_rows. batch: two keys, and of each page's items in their order a list a property."""
    lists = {name: batch.column(2 + k) for k, name in enumerate((*PLACES, "text"))}
    offsets = lists["y"].offsets.to_numpy().astype(np.int64)
    values = {name: lists[name].flatten().to_numpy(zero_copy_only=False) for name in PLACES}
    page = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    ys, row, down = values["y"].tolist(), np.empty(len(page), np.int64), np.empty(len(page))
    base, offsets = 0, offsets - offsets[0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, firsts = first_fit(ys[a:b], gap)
        row[a:b], down[a:b] = own, -np.array(firsts)[own] if own else []
        row[a:b] += base
        base += len(firsts)
    # rows downwards (of equal places, the one opened first), cells to the right (of equal places, in the order of items)
    order = np.lexsort((values["x"], row, down, page))
    row = row[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    begins = np.flatnonzero(new)
    row_ends = np.append(begins, len(row))
    cell_index = np.arange(len(row)) - np.repeat(begins, np.diff(row_ends))
    pages_of_rows = page[order][begins]
    page_ends = np.searchsorted(pages_of_rows, np.arange(batch.num_rows + 1))
    row_index = np.arange(len(begins)) - page_ends[:-1][pages_of_rows]
    text = lists["text"].flatten().take(pa.array(order))
    cell_type = kind.value_type.field("cells").type
    cells = pa.StructArray.from_arrays([pa.array(cell_index.astype(np.int32)), *[pa.array(values[n][order]) for n in PLACES], text.cast(pa.string())], fields=list(cell_type.value_type))
    rows = pa.StructArray.from_arrays([pa.array(row_index.astype(np.int32)), pa.array(-down[order][begins]), pa.ListArray.from_arrays(pa.array(row_ends.astype(np.int32)), cells)], fields=list(kind.value_type))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(page_ends.astype(np.int32)), rows)], ["document_id", "page_number", "item_rows"])


def _begins(table: pa.Table) -> np.ndarray:
    """Where the pages of items begin that come one after another; the keys are the first two columns."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in table.columns[:2]:
        codes = key.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the same items that end where a page ends."""
    held: list[pa.RecordBatch] = []  # of one page, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_begins(pa.Table.from_batches([batch]))[-1])
        if held and (last or len(_begins(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) > 1):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _listed(table: pa.Table) -> pa.RecordBatch:
    """Pages out of items that come page by page: two keys, and of each page's items in their order a list a property."""
    begins = _begins(table)
    page = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
    place = table.column("item_ord")
    places = place.to_numpy() if not place.null_count else None
    if places is None or not ((places[1:] > places[:-1]) | (page[1:] != page[:-1])).all():
        # as array_sort has it: unknown places first, equal ones by what the items are
        keyed = table.append_column("page", pa.array(page)).append_column("known", pc.cast(place.is_valid(), pa.int8()))
        table = table.take(pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in ("page", "known", "item_ord", *PLACES, "text")]))
    ends = pa.array(np.append(begins, table.num_rows).astype(np.int32))
    keys = [table.column(k).combine_chunks().take(pa.array(begins)) for k in (0, 1)]
    lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in (*PLACES, "text")]
    return pa.RecordBatch.from_arrays([*keys, *lists], [*table.column_names[:2], *PLACES, "text"])


def rows_of(items: DataFrame, gap: float = ROW_GAP, together: bool = False) -> DataFrame:
    """Pages with item_rows: [row_index, y, cells [cell_index, x, y, width, height, text]], rows downwards, cells to the right.

    A page's items meet in one row of the table: a page is bounded by what fits on paper. together: the caller knows that a page's
    items lie one after another in one partition, as where each page's row was exploded; they are not shuffled or sorted then.
    """
    # blank items go before the shuffle
    full = items.withColumn("text", trimmed(F.coalesce("str", F.lit("")))).where("text != ''")
    placed = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PLACES]
    if together:
        listed = full.select("document_id", "page_number", "item_ord", *placed, "text")
    else:
        pages = full.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("item_ord", *placed, "text"))).alias("items"))
        listed = pages.select("document_id", "page_number", *[F.col(f"items.{c}").alias(c) for c in (*PLACES, "text")])
    cell = pa.struct([("cell_index", pa.int32()), *[(c, pa.float64()) for c in PLACES], ("text", pa.string())])
    kind = pa.list_(pa.struct([("row_index", pa.int32()), ("y", pa.float64()), ("cells", pa.list_(cell))]))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_listed, _whole_pages(batches)) if together else batches:
            if batch.num_rows:
                yield _shaped(batch, gap, kind)

    id_type, page_type = (items.schema[c].dataType.simpleString() for c in ("document_id", "page_number"))
    return listed.mapInArrow(shape, _ROWS.format(id=id_type, page=page_type))


def page_text(item_rows: Column) -> Column:
    """Cells joined by spaces, rows by line breaks."""
    return F.array_join(F.transform(item_rows, lambda r: F.array_join(F.transform(r.cells, lambda c: c.text), " ")), "\n")


def pages_of(items: DataFrame, gap: float = ROW_GAP, together: bool = False) -> DataFrame:
    return rows_of(items, gap, together).select("document_id", "page_number", page_text(F.col("item_rows")).alias("text"), "item_rows")


def cells_of(pages: DataFrame) -> DataFrame:
    """One row for each cell of pages with item_rows."""
    rows = pages.select("document_id", "page_number", F.explode("item_rows").alias("row"))
    cells = rows.select("document_id", "page_number", F.col("row.row_index").alias("row_index"), F.col("row.y").alias("row_y"), F.explode("row.cells").alias("cell"))
    return cells.select("document_id", "page_number", "row_index", "row_y", "cell.*")
