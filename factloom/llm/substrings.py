"""Exact removal of repeated substrings by blockwise suffix sorting with difference covers.

Which places start a LENGTH-byte string that also starts elsewhere is a question about ties in a suffix array. It is answered in
two sorts, each a bucket at a time:

1. Sparse cover. PERIOD and its cover form a difference cover: for any two places i and j there is a d < PERIOD with i + d and j + d
   both in the sample, so two equal LENGTH-byte strings hold two equal strings of LENGTH - PERIOD + 1 bytes at sampled places. The
   sampled suffixes alone (8 % of all) are ranked; only those that tie matter further on.
2. Suffixes. Of the places whose string holds a tied sample, those in a dense cover (4 of each 13) are ranked on 388 bytes. A
   suffix at p - d, with p the cover place it shares with a suffix that it is compared to, orders by its first d bytes, the rank of
   p, and the bytes behind: a tie of 388 bytes is settled by the rank, and only the 12 bytes around it are compared (shift_ties()).
   So a suffix costs a bucket 13 bytes, whatever its length, and no text has to be where its suffixes are sorted.

Both sorts deal suffixes to buckets by the leading bits of their rank's print, and a task holds one bucket at a time. The ranks of
the second sort order 128-bit prints, those of the first, which only choose candidates, 64-bit ones. A slab (a run of texts) settles
its own ties and sends each distinct suffix once, so a string that every document has costs a bucket one entry a slab. A text that
is there more than once takes part once: all of it is removed. Bitmaps of hashed ids, of a bounded size, keep texts without ties
out of the joins.

Passages of over PASSAGE - 1 words that another document has too are found in the same way, words in place of bytes: a passage of
short words has fewer than LENGTH bytes, so nothing of it is removed, but the document is reported (`shares_passage`).

Defined results: a null or empty text has no bytes; texts shorter than LENGTH stay whole; repeated rows are documents of
their own, so their strings repeat; a null id is carried along; other columns of the input are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, in_arrow, release, stash, unstash
from .neardup import WORD_BYTES, marks
from .words import BASE, BYTE_VALUES, INVERSE, _powers, byte_column, mix, word_hashes, word_spans

LENGTH = 400
PASSAGE = 51
TASK_BYTES, LEAST_TASK_BYTES = 16 << 20, 1 << 20
BUCKETS_A_TASK = 4


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(period, cover) of Singer's perfect difference set for a prime q: period q*q + q + 1, q + 1 residues.

    The powers of a generator of GF(q^3) that lie in a plane have exponents whose differences give every residue once.
    """
    period = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(period):
                    if x[2] == 0:
                        found.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)  # times the generator
                if len(found) == q + 1 and len({(m - n) % period for m in found for n in found}) == period:
                    return period, np.array(found)
    raise ValueError(f"{q} is no prime")


class Cover(NamedTuple):
    period: int
    holds: np.ndarray

    @classmethod
    def of(cls, q: int) -> Cover:
        period, cover = difference_cover(q)
        holds = np.zeros(period, bool)
        holds[cover] = True
        return cls(period, holds)


class Symbols(NamedTuple):
    """What strings are made of. whole: texts are not cut, and a string has to be in two texts."""

    length: int
    sparse: Cover
    dense: Cover | None  # None: every place
    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    values: tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]
    whole: bool
    slab: int  # symbols that are sorted together before any are sent

    @property
    def around(self) -> int:
        return self.dense.period - 1 if self.dense else 0


#: Unlike for words, upper and lower case differ here.
VALUES = BYTE_VALUES.copy()
VALUES[65:91] = mix(np.arange(65, 91, dtype=np.uint64)) | np.uint64(1)


def second(values: np.ndarray) -> np.ndarray:
    """Other values for the same symbols, for a print that is independent of the first."""
    return mix(values ^ np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


SECOND_VALUES = second(VALUES)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words, offsets of texts in them)."""
    data, offsets = byte_column(texts)
    starts, ends, rows = word_spans(data, offsets, WORD_BYTES)
    return word_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


BYTES = Symbols(LENGTH, Cover.of(13), Cover.of(3), byte_column, (lambda data: VALUES[data], lambda data: SECOND_VALUES[data]), False, 2 << 20)
WORDS = Symbols(PASSAGE, Cover.of(5), None, words_of, (lambda hashes: hashes, second), True, 1 << 18)


# ---- one slab ---------------------------------------------------------------------------------------------------------------


def slab_pieces(offsets: np.ndarray, length: int, most: int, whole: bool = False) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, begin in the row, end in the row) of about `most` symbols; parts of a long row overlap by length - 1."""
    held, size = [], 0
    for row, n in enumerate(np.diff(offsets).tolist()):
        at = 0
        while at == 0 or at < n - length + 1:
            end = n if whole else min(n, at + most)
            if held and size + end - at > most:
                yield held
                held, size = [], 0
            held.append((row, at, end))
            size += end - at
            at = end - length + 1 if end < n else n
            if end == n:
                break
    if held:
        yield held


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(BASE, n), _powers(INVERSE, n)]
    return _TABLES[0], _TABLES[1]


def prints(values: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit prints of the `length` symbols at places, from the values of all symbols."""
    powers, inverses = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix((sums[places + length] - sums[places]) * inverses[places])


class Suffixes(NamedTuple):
    """Cover places with what orders the suffixes that lead to them."""

    print: np.ndarray
    check: np.ndarray  # a second print, or nothing
    near: np.ndarray  # (n, 2 * around) symbols before and behind the ranked string; 0 outside of the text
    least: np.ndarray  # the shifts d, from least to most, that lead to suffixes of full length
    most: np.ndarray

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(*[x[at] if len(x) else x for x in self])

    def by_rank(self) -> np.ndarray:
        order = np.argsort(self.print, kind="stable")
        if len(self.check):
            value, check = self.print[order], self.check[order]
            if ((value[1:] == value[:-1]) & (check[1:] != check[:-1])).any():  # one print for two strings
                return np.lexsort((self.check, self.print))
        return order


def ranks(ordered: Suffixes) -> np.ndarray:
    """The rank of each of some suffixes in the order of by_rank(): equal prints, equal ranks."""
    new = np.ones(len(ordered.print), np.int64)
    new[1:] = ordered.print[1:] != ordered.print[:-1]
    if len(ordered.check):
        new[1:] |= ordered.check[1:] != ordered.check[:-1]
    return np.cumsum(new) - 1


def neighbours_equal(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys equal the one before or behind."""
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for key in keys:
        same &= key[1:] == key[:-1]
    out = np.zeros(len(keys[0]), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def alike(ordered: Suffixes, rank: np.ndarray, around: int) -> np.ndarray:
    """Of each rank, whether all its entries have the same symbols on both sides, as many as there can be."""
    size = np.bincount(rank)
    if not around:
        return np.ones(len(size), bool)
    several = np.flatnonzero(size[rank] > 1)
    first = np.flatnonzero(np.diff(rank, prepend=-1))
    near = np.ascontiguousarray(ordered.near).view(np.uint32)
    own = (near[several] == near[first[rank[several]]]).all(axis=1) & (ordered.least[several] == 0) & (ordered.most[several] == around)
    return (size == 1) | (np.bincount(rank[several[own]], minlength=len(size)) == size)


def shift_ties(ordered: Suffixes, around: int) -> np.ndarray:
    """Bit d of entry k: the suffix d symbols before cover place k ties with another one. Entries are in the order of by_rank().

    Within a rank, suffixes d before their cover places order by the d symbols before and the around - d behind. Where all entries of
    a rank are alike, nothing is left to sort.
    """
    rank = ranks(ordered)
    out = np.where(np.bincount(rank)[rank] > 1, np.uint16((1 << (around + 1)) - 1), np.uint16(0))
    if not around or not out.any():
        return out
    mixed = np.flatnonzero(~alike(ordered, rank, around)[rank])
    out[mixed] = 0
    for d in range(around + 1):
        at = mixed[(ordered.least[mixed] <= d) & (ordered.most[mixed] >= d)]
        if len(at) < 2:
            continue
        beside = np.ascontiguousarray(ordered.near[at, around - d : 2 * around - d])
        keys = (*beside.view(np.uint32).T, rank[at])
        order = np.lexsort(keys)
        tied = neighbours_equal(*[k[order] for k in keys])
        out[at[order[tied]]] |= np.uint16(1 << d)
    return out


def distinct(ordered: Suffixes, around: int) -> np.ndarray:
    """One place of each group of entries, ordered by rank, that are equal in all."""
    rank = ranks(ordered)
    whole = alike(ordered, rank, around)[rank]
    first = np.flatnonzero(whole & (np.diff(rank, prepend=-1) > 0))
    mixed = np.flatnonzero(~whole)
    if not len(mixed):
        return first
    keys = (ordered.most[mixed], ordered.least[mixed], *np.ascontiguousarray(ordered.near[mixed]).view(np.uint32).T, rank[mixed])
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return np.concatenate([first, mixed[order[new]]])


def planes(values: np.ndarray) -> bytes:
    """Numbers, or rows of bytes, as their first bytes, then their second ones and so on: what shuffles and files compress well if the top bytes agree."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def from_planes(data: bytes, kind: type, wide: int = 1) -> np.ndarray:
    made = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize * wide, -1).T).view(kind)
    return made if wide > 1 else made.ravel()


def steps(places: np.ndarray) -> bytes:
    """Ascending places as the planes of their differences."""
    return planes(np.diff(places.astype(np.int32), prepend=np.int32(0)).astype(np.int32))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.int32), dtype=np.int64).astype(np.int32)


# ---- a sort over all slabs --------------------------------------------------------------------------------------------------

_ENTRY = {"bucket": "int", "slab": "long", "places": "binary", "shifts": "binary", "prints": "binary", "checks": "binary", "near": "binary", "reach": "binary"}
_OWN = {"ids": "array<long>", "hashes": "array<long>", "starts": "array<int>", "bases": "array<long>"}
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
_DEALT = _ENTRY | _OWN
_TIED = {k: v for k, v in _DEALT.items() if k in ("slab", "places", "shifts") or k in _OWN}
_RUNS = {"id": "long", "hash": "long", "runs": "binary"}


def _spark(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _batch(rows: list[dict], fields: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(k, _KINDS[v]) for k, v in fields.items()]))


def suffixes(joined: np.ndarray, places: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, around: int, checked: bool, values) -> Suffixes:
    """Of the cover places (indices into joined), each in a piece from begins to ends, ranked on `length` symbols."""
    least, most = np.maximum(0, places + length + around - ends).astype(np.int8), np.minimum(around, places - begins).astype(np.int8)
    near = np.zeros((len(places), 0), np.uint8)
    if around:
        padded = np.concatenate([np.zeros(around, joined.dtype), joined, np.zeros(around, joined.dtype)])
        shift = np.arange(around)
        before = padded[places[:, None] + shift] * (around - shift <= most[:, None])
        behind = padded[places[:, None] + around + length + shift] * (shift < around - least[:, None])
        near = np.concatenate([before, behind], axis=1)
    return Suffixes(prints(values[0](joined), places, length), prints(values[1](joined), places, length) if checked else np.zeros(0, np.uint64), near, least, most)


def tied_places(rows: DataFrame, symbols: Symbols, cover: bool, tasks: int, chosen) -> DataFrame:
    """id, hash, runs: where in each text a suffix ties with another one.

    rows: id, hash, text and whatever else `chosen` needs. cover: rank the sparse cover's strings; else the full strings. chosen(batch,
    pieces, starts, sizes) -> the places, as indices into the joined pieces, that take part.
    """
    around = 0 if cover else symbols.around
    length = symbols.length - symbols.sparse.period + 1 if cover else symbols.length - around
    checked, across = not cover, symbols.whole and not cover
    buckets = 1 << max(4, (BUCKETS_A_TASK * tasks - 1).bit_length())
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slab = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = symbols.read(batch.column(2))
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for pieces in slab_pieces(offsets, symbols.length, symbols.slab, symbols.whole):
                sizes = np.array([e - b for _, b, e in pieces])
                starts = np.cumsum(sizes) - sizes
                joined = np.concatenate([data[offsets[r] + b : offsets[r] + e] for r, b, e in pieces])
                places = chosen(batch, pieces, starts, sizes)
                if not len(places):
                    continue
                slab += 1
                piece = np.searchsorted(starts, places, "right") - 1
                made = suffixes(joined, places, starts[piece], (starts + sizes)[piece], length, around, checked, symbols.values)
                order = made.by_rank()
                made, place, piece = made.take(order), places[order].astype(np.int32), piece[order]
                tied = shift_ties(made, around)
                if across:  # what only one text has is no tie
                    rank = ranks(made)
                    lone = np.ones(len(rank) and rank[-1] + 1, bool)
                    lone[rank[1:][(rank[1:] == rank[:-1]) & (piece[1:] != piece[:-1])]] = False
                    tied[lone[rank]] = 0
                own = np.flatnonzero(tied)
                own = own[np.argsort(place[own])]
                out = [{"bucket": -1, "slab": slab, "places": steps(place[own]), "shifts": planes(tied[own]), "ids": [ids[p[0]] for p in pieces], "hashes": [hashes[p[0]] for p in pieces], "starts": starts.tolist(), "bases": [p[1] for p in pieces]}]
                kept = distinct(made, around)
                bucket = (made.print[kept] >> shift).astype(np.int64)
                kept = kept[np.lexsort((place[kept], bucket))]
                bucket = (made.print[kept] >> shift).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    one = made.take(kept[a:b])
                    entry = {"bucket": int(bucket[a]), "slab": slab, "places": steps(place[kept[a:b]]), "prints": planes(one.print)}
                    if checked:
                        entry["checks"] = planes(one.check)
                    if around:
                        entry |= {"near": planes(one.near), "reach": planes(np.stack([one.least, one.most], axis=1))}
                    out.append(entry)
                yield _batch(out, _DEALT)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            """Sorts one bucket."""
            each = [from_planes(r["prints"], np.uint64) for r in held]
            none = np.zeros((sum(map(len, each)), 0), np.uint8)
            reach = np.concatenate([from_planes(r["reach"], np.int8, 2) for r in held]) if around else np.zeros((len(none), 2), np.int8)
            made = Suffixes(np.concatenate(each), np.concatenate([from_planes(r["checks"], np.uint64) for r in held]) if checked else np.zeros(0, np.uint64), np.concatenate([from_planes(r["near"], np.uint8, 2 * around) for r in held]) if around else none, reach[:, 0], reach[:, 1])
            order = made.by_rank()
            tied = np.zeros(len(order), np.uint16)
            tied[order] = shift_ties(made.take(order), around)
            ends, out = np.cumsum([len(v) for v in each]), []
            for r, e, n in zip(held, ends, map(len, each), strict=True):
                own = tied[e - n : e]
                if own.any():
                    out.append({"slab": r["slab"], "places": steps(from_steps(r["places"])[own > 0]), "shifts": planes(own[own > 0])})
            return _batch(out, _TIED)

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield _batch([{k: row[k] for k in _TIED}], _TIED)
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    def to_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a slab come one after the other, the slab's own row, which says where its texts begin, among them."""
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            own = next(r for r in held if r["ids"] is not None)
            found = [(from_steps(r["places"]), from_planes(r["shifts"], np.uint16)) for r in held if r["places"]]
            out = []
            if found:
                place, bits = np.concatenate([p for p, _ in found]).astype(np.int64), np.concatenate([b for _, b in found])
                at = np.unique(np.concatenate([place[bits >> d & 1 > 0] - d for d in range(around + 1)]))
                starts, bases = np.asarray(own["starts"]), np.asarray(own["bases"])
                piece = np.searchsorted(starts, at, "right") - 1
                cuts = np.flatnonzero(np.diff(piece)) + 1
                for part, k in zip(np.split(at, cuts), piece[np.concatenate([[0], cuts])], strict=True):
                    out.append({"id": own["ids"][k], "hash": own["hashes"][k], "runs": runs(part - starts[k] + bases[k]).tobytes()})
            return _batch(out, _RUNS)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["slab"] != row["slab"]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    key = F.when(F.col("bucket") < 0, F.col("slab")).otherwise(F.col("bucket").cast("long"))
    dealt = in_arrow(rows, deal, _spark(_DEALT)).repartition(tasks, key).sortWithinPartitions("bucket")
    settled = stash(dealt.mapInArrow(freed(settle), _spark(_TIED)), "ties")
    by_slab = settled.repartition(tasks, "slab").sortWithinPartitions("slab")
    found = stash(by_slab.mapInArrow(freed(to_texts), _spark(_RUNS)).groupBy("id", "hash").agg(F.collect_list("runs").alias("runs")), "runs")
    unstash(settled)
    release(rows.sparkSession)
    return found


def runs(places: np.ndarray) -> np.ndarray:
    """[first, last] of each maximal run of consecutive places, flat."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]], axis=1).astype(np.int64).ravel()


def sampled(symbols: Symbols):
    """Chooses the sparse cover's places whose strings lie in the text."""
    length = symbols.length - symbols.sparse.period + 1

    def choose(batch: pa.RecordBatch, pieces: list, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = []
        for (_, base, _), start, size in zip(pieces, starts, sizes, strict=True):
            if size >= symbols.length:
                out.append(start + np.flatnonzero(symbols.sparse.holds[(base + np.arange(size - length + 1)) % symbols.sparse.period]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    return choose


def holding_ties(symbols: Symbols):
    """Chooses the places, of the dense cover if there is one, that suffixes lead to which hold a tied sample."""
    around = symbols.around

    def choose(batch: pa.RecordBatch, pieces: list, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        lists = batch.column(3).to_pylist()
        out = []
        for (row, base, _), start, size in zip(pieces, starts, sizes, strict=True):
            if size < symbols.length:
                continue
            cover = np.zeros(size + around + 2, np.int32)
            for flat in lists[row]:
                spans = np.frombuffer(flat, np.int64).reshape(-1, 2)
                first = np.clip(spans[:, 0] - symbols.sparse.period + 1 - base, 0, size)
                last = np.clip(spans[:, 1] - base, -1, size - symbols.length)
                some = first <= last
                np.add.at(cover, first[some], 1)
                np.add.at(cover, last[some] + around + 1, -1)
            led = np.cumsum(cover[: size - symbols.length + around + 1]) > 0
            if symbols.dense:
                led &= symbols.dense.holds[(base + np.arange(len(led))) % symbols.dense.period]
            out.append(start + np.flatnonzero(led))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    return choose


# ---- over tables ------------------------------------------------------------------------------------------------------------


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def parted_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, held, alone) of rows (id, hash, text): every text once; the rows that may be copies, with `again` if they are; all other rows.

    A whole text that is there again is removed from its first byte to its last, so only one row of it takes part in the sorts. Texts
    are held to be equal by two 64-bit hashes and their length.
    """
    keys = {"check": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")}
    prints = rows.select("id", "hash", *[c.alias(n) for n, c in keys.items()]).where(F.col("n_bytes") >= SHORTEST)
    repeated = stash(prints.groupBy("hash", *keys).agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    bitmap = marks(repeated.select(F.col("hash").alias("id")))
    maybe = _filtered(rows, bitmap, True).withColumns(keys).join(repeated.withColumn("again", F.lit(True)), ["hash", *keys], "left")
    held = stash(maybe.select("id", "hash", "text", "again", "kept_id"), "copies")
    unstash(repeated)
    once = held.where(F.col("again").isNull() | F.col("id").eqNullSafe(F.col("kept_id"))).select("id", "hash", "text")
    alone = _filtered(rows, bitmap, False).select("id", "hash", "text")
    return alone.unionByName(once), held, alone


SHORTEST = 2 * PASSAGE - 1  # bytes of a text that can be removed or share a passage


def repeated_runs(rows: DataFrame, symbols: Symbols, tasks: int) -> DataFrame:
    """id, hash, runs: for texts with any, the runs of places whose full strings also start elsewhere (lists of [first, last]). rows: id, hash, text."""
    sample = tied_places(rows, symbols, True, tasks, sampled(symbols))
    bitmap = marks(sample.select(F.col("hash").alias("id")).distinct())
    held = _filtered(rows, bitmap, True)
    joined = held.join(sample.withColumnRenamed("id", "other_id").withColumnRenamed("hash", "other"), F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other"))).select("id", "hash", "text", "runs")
    found = tied_places(joined, symbols, False, tasks, holding_ties(symbols))
    unstash(sample)
    return found


def _filtered(rows: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """The rows (id, hash, text) whose hash is in the bitmap, or those whose hash isn't."""
    bits = 8 * len(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array((bitmap[slot >> 3] >> (7 - (slot & 7)) & 1 == 1) == inside)).select(["id", "hash", "text"])

    return in_arrow(rows.withColumn("slot", F.pmod(F.xxhash64("hash"), F.lit(bits))), keep, "id long, hash long, text string")


def removal_spans(lists: list[bytes]) -> np.ndarray:
    """(begin, end) of the maximal removed runs of bytes, from runs of starting places."""
    spans = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists]) if lists else np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    ends = np.maximum.accumulate(spans[:, 1] + LENGTH)
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], ends[last]], axis=1)


def repeats_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Symbols, Symbols] = (BYTES, WORDS)) -> DataFrame:
    """One row per input row: <id_col>, n_bytes, n_removed, n_spans, kept_sha256, shares_passage."""
    keyed = _keyed(documents, id_col, text_col)
    n = int(keyed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    tasks = max(1 + n // TASK_BYTES, min(documents.sparkSession.sparkContext.defaultParallelism, 1 + n // LEAST_TASK_BYTES))
    texts, held, alone = parted_copies(keyed)
    gone, shared = (repeated_runs(texts, kind, tasks) for kind in kinds)
    both = gone.withColumn("shares", F.lit(False)).unionByName(shared.select("id", "hash", F.array().cast("array<binary>").alias("runs"), F.lit(True).alias("shares")))
    found = stash(both.groupBy("id", "hash").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("shares").alias("shares")), "repeats")
    unstash(gone, shared)
    copies = held.where("again")
    # a row that stood for its copies took part for the others' sake; its own result is theirs
    rows = alone.unionByName(held.where("again is null").select("id", "hash", "text"))
    bitmap = marks(found.select(F.col("hash").alias("id")).distinct())
    named = found.withColumnRenamed("id", "other_id").withColumnRenamed("hash", "other")
    touched = _filtered(rows, bitmap, True).join(named, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other")), "left").select("id", "text", "runs", F.coalesce("shares", F.lit(False)).alias("shares_passage"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            out = []
            for row, lists in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[row] : offsets[row + 1]]
                spans = removal_spans(lists or [])
                kept, at = hashlib.sha256(), 0
                for begin, end in spans.tolist():
                    kept.update(own[at:begin].tobytes())
                    at = end
                kept.update(own[at:].tobytes())
                out.append((len(own), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], batch.column(3)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean"
    n_bytes, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    is_whole = _filtered(rows, bitmap, False).select("id", n_bytes.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit(False).alias("shares_passage"))
    long_enough = n_bytes >= LENGTH
    kept_text = F.when(long_enough, F.lit("")).otherwise(F.col("text")).cast("binary")
    has_passage = F.col("text").rlike(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}" % PASSAGE)
    removed = copies.select("id", n_bytes.alias("n_bytes"), F.when(long_enough, n_bytes).otherwise(none).alias("n_removed"), long_enough.cast("long").alias("n_spans"), F.sha2(kept_text, 256).alias("kept_sha256"), has_passage.alias("shares_passage"))
    return in_arrow(touched, cut, schema).unionByName(is_whole).unionByName(removed).withColumnRenamed("id", id_col)
