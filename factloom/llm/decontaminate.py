"""Benchmark decontamination by an FM-index per training shard.

A shard is a run of texts of about SLAB_BYTES. Its words become numbers of the benchmark's vocabulary; a word outside of it can
be in no test phrase and parts the text. Over the rest the task builds an FM-index: suffixes sorted by prefix doubling, the
Burrows-Wheeler transform in a wavelet tree, every SAMPLE-th suffix position. All test phrases of a block are searched backward
at once, their occurrences located by walking to sampled suffixes, and the spans merged into removal spans per document.

The benchmark is read in blocks of at most BLOCK_CHARS characters; a block travels with the task's function, and several blocks
are searched one after the other over the same rows, which carry the spans found so far and are written between two blocks, so that
driver and tasks hold one block at a time.

Defined results: a null or blank text has no words and is never contaminated; a null or wordless item has no window; equal
item ids count once, a null item id is named "null"; repeated rows give repeated results; other columns, whatever their names,
are handed on unread; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, numbered, sha256_of, stash, unstash
from .words import byte_column, new_seed, slabs, word_hashes, word_spans

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_CHARS = 16 << 20
SAMPLE = 16
PERCENT = 5

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ---- test phrases -----------------------------------------------------------------------------------------------------------


class Phrases:
    """The distinct windows of a block of items, as rows of vocabulary numbers, filled from the right."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        data, offsets = byte_column(pa.array(texts, pa.string()))
        starts, ends, rows = word_spans(data, offsets, WORD_BYTES)
        self.seed = new_seed()
        hashes = word_hashes(data, starts, ends, self.seed)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.names = sorted(set(ids))
        name_of = {x: k for k, x in enumerate(self.names)}
        found: dict[tuple, set[int]] = {}
        for k, item in enumerate(ids):
            words = numbers[bounds[k] : bounds[k + 1]].tolist()
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                found.setdefault(tuple(words[i : i + WINDOW]), set()).add(name_of[item])
        windows = sorted(found)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.table = np.full((len(windows), WINDOW), -1, np.int64)
        for k, w in enumerate(windows):
            self.table[k, WINDOW - len(w) :] = w
        owners = [sorted(found[w]) for w in windows]
        self.first_owner = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words; -1 for a word in no test phrase."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


# ---- index ------------------------------------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; each `ends` position is an end mark of its own, smaller than all symbols."""
    n = len(symbols)
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    _, rank = np.unique(key, return_inverse=True)
    rank = rank.astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        open_at = np.zeros(n, bool)
        open_at[1:] |= same
        open_at[:-1] |= same
        todo = np.flatnonzero(open_at)
        if not len(todo):
            return order
        place = order[todo]
        second = np.where(place + step < n, rank[np.minimum(place + step, n - 1)], -1)
        by = np.lexsort((second, rank[place]))
        place, second = place[by], second[by]
        order[todo] = place
        new = np.ones(len(todo), bool)
        new[1:] = (rank[place[1:]] != rank[place[:-1]]) | (second[1:] != second[:-1])
        rank[place] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        first_of = np.flatnonzero(~open_at)
        rank[order[first_of]] = first_of
        step *= 2


class WaveletTree:
    """Ranks over a sequence of small numbers: a bit vector with running counts for each bit, most significant first."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels, self.zeros = [], []
        row = symbols
        for bit in range(self.bits - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(int(len(row) - ones.sum()))
            row = np.concatenate([row[~ones], row[ones]])
        self.final = row

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin, end = np.zeros_like(upto), upto
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.levels[level], self.zeros[level]
            b, e = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            up = (symbols >> bit & 1).astype(bool)
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        return end - begin


class FMIndex:
    """Over runs of symbols (0 and up), each closed by an end mark."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """symbols: -1 at `ends`."""
        n = len(symbols)
        order = suffix_order(symbols, ends)
        shifted = symbols + 1  # 0: end mark
        self.bwt = shifted[order - 1]
        self.tree = WaveletTree(self.bwt)
        counts = np.bincount(shifted, minlength=int(shifted.max(initial=0)) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # sampled: every SAMPLE-th position, and the first of each run, so that no walk crosses an end mark
        keep = np.zeros(n, bool)
        keep[::SAMPLE] = True
        keep[ends[:-1] + 1] = True
        self.sampled = keep[order]
        self.sample_at = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def ranges(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in suffix order of each phrase of table, filled from the right; one symbol a step, backward."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), len(self.bwt), np.int64)
        alive = np.arange(len(table))
        for step in range(table.shape[1]):
            alive = alive[lengths[alive] > step]
            symbol = table[alive, table.shape[1] - 1 - step] + 1
            known = symbol < len(self.before) - 1
            high[alive[~known]] = low[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.sample_at[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            symbol = self.bwt[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


def search_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(words per row, rows of words, hit flags of words, distinct (row, item number)) of a shard's texts."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, WORD_BYTES)
    numbers = phrases.number(word_hashes(data, starts, ends, phrases.seed))
    count = np.bincount(rows, minlength=n)
    hit = np.zeros(len(rows), bool)
    none: list[tuple[int, int]] = []
    if not len(phrases.table) or not len(rows):
        return count, rows, hit, none
    breaks = np.ones(len(rows) + 1, bool)
    breaks[1:-1] = rows[1:] != rows[:-1]
    known = numbers >= 0
    begins = np.flatnonzero(known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]])))
    closes = np.flatnonzero(known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = closes - begins >= phrases.shortest  # a shorter run has no room for any test phrase
    begins, closes = begins[long], closes[long]
    if not len(begins):
        return count, rows, hit, none
    sizes = closes - begins + 1  # with the end mark
    marks = np.cumsum(sizes) - 1
    place = np.arange(int(sizes.sum())) - np.repeat(marks - sizes + 1, sizes) + np.repeat(begins, sizes)  # word of each symbol
    symbols = numbers[np.minimum(place, len(numbers) - 1)]
    symbols[marks] = -1
    index = FMIndex(symbols, marks)
    low, high = index.ranges(phrases.table, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return count, rows, hit, none
    times = high[found] - low[found]
    window = np.repeat(found, times)
    suffix = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
    word = place[index.locate(suffix)]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    met = np.unique(rows[word] * len(phrases.table) + window)
    row, window = met // len(phrases.table), met % len(phrases.table)
    held = np.diff(phrases.first_owner)[window]
    owner = phrases.owners[np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held) + np.repeat(phrases.first_owner[window], held)]
    pairs = np.unique(np.repeat(row, held) * len(phrases.names) + owner)
    return count, rows, hit, list(zip((pairs // len(phrases.names)).tolist(), (pairs % len(phrases.names)).tolist(), strict=True))


# ---- over tables ------------------------------------------------------------------------------------------------------------

_WORDS, _SPANS, _ITEMS = "__n_words", "__hit_spans", "__hit_items"


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[Phrases]:
    """Blocks of items, each of a bounded size: dealt by a hash of the row, and counted before they are fetched."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-int(total) * 2 // block_chars) if total > block_chars else 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        yield Phrases([r["id"] for r in rows], [r["text"] for r in rows])


def with_hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents with __n_words, __hit_spans (word places, end exclusive, merged) and __hit_items."""
    found = documents.withColumns({_WORDS: F.lit(0).cast("long"), _SPANS: F.array().cast("array<struct<start:long,end:long>>"), _ITEMS: F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.schema])
    at = documents.columns.index(text_col)
    written = None
    for n, phrases in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, block_chars)):
        if n:
            found, before = stash(found, "hits"), written
            written = found
            unstash(*([before] if before is not None else []))
        found = found.mapInArrow(freed(_searcher(phrases, at)), schema)
    return found


def _searcher(phrases: Phrases, at: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = byte_column(batch.column(at))
            for first, last in slabs(offsets, SHARD_BYTES):
                part = batch.slice(first, last - first)
                count, rows, hit, met = search_shard(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], phrases)
                spans = part.column(part.num_columns - 2).to_pylist()
                items = part.column(part.num_columns - 1).to_pylist()
                if hit.any():
                    top = np.cumsum(count) - count
                    flags = np.concatenate([[False], hit, [False]])
                    edge = np.concatenate([[True], rows[1:] != rows[:-1], [True]])
                    starts = np.flatnonzero(flags[1:-1] & (~flags[:-2] | edge[:-1]))
                    ends = np.flatnonzero(flags[1:-1] & (~flags[2:] | edge[1:])) + 1
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        row = rows[a]
                        spans[row].append({"start": a - int(top[row]), "end": b - int(top[row])})
                    for row, item in met:
                        items[row].append(phrases.names[item])
                own = [pa.array(count.astype(np.int64)), pa.array([_merged(s) for s in spans], batch.schema.field(batch.num_columns - 2).type), pa.array([sorted(set(i)) for i in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *own], batch.schema.names)

    return search


def _merged(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans as one."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _n_hit() -> Column:
    return F.aggregate(_SPANS, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])


def contaminated() -> Column:
    return (_n_hit() > 0) & (_n_hit() * F.lit(100 // PERCENT) >= F.col(_WORDS))


def contamination_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = with_hits(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark)
    items = F.array_join(F.col(_ITEMS), ",")
    return found.select(F.col("id").alias(id_col), F.col(_WORDS).alias("n_words"), _n_hit().alias("n_hit"), F.size(_ITEMS).cast("long").alias("n_items"), sha256_of(items).alias("items_sha256"), contaminated().alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """documents without those that are contaminated; the others as they are."""
    rows, (text,) = numbered(documents, text_col)
    return with_hits(rows, benchmark, text).where(~contaminated()).drop(_WORDS, _SPANS, _ITEMS).toDF(*documents.columns)
