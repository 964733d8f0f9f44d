"""Words and their hashes for whole Arrow columns of texts, in numpy, within one task."""

from __future__ import annotations

import functools
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20
HASH_BYTES = 1 << 17
CHUNK = 64
_random = np.random.Generator(np.random.PCG64(20240229))
#: Values of bytes for prints of strings (substrings.py); A-Z count as a-z.
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)


def new_seed() -> int:
    """A seed of word hashes that nobody could know when the texts were written; one for all jobs of an operator."""
    return secrets.randbits(63)


@functools.lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    """A random value for each byte at each place of a CHUNK, A-Z as a-z."""
    values = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (CHUNK, 256), dtype=np.uint64)
    values[:, 65:91] = values[:, 97:123]
    return values.reshape(-1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts or binaries; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, most: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last + 1) of about `most` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of word bytes that stay within a row."""
    inside = word_bytes[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins, ends = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]
        last[ends - 1] = inside[ends - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words (A-Z as a-z), some bytes at a time.

    Each CHUNK of a word adds up a random value for each of its bytes by place (tabulation hashing), so two words have equal hashes
    with a chance of 2^-64 over the seeds, whatever the words are: no pair collides by how it is built.
    """
    out, k, n = np.empty(len(starts), np.uint64), 0, len(starts)
    sizes = ends - starts
    while k < n:
        if sizes[k] > HASH_BYTES:
            out[k] = _long_hash(data[starts[k] : ends[k]], seed)
            k += 1
            continue
        upto = max(k + 1, int(np.searchsorted(ends, starts[k] + HASH_BYTES, "right")))
        out[k:upto] = mix(_added(data, starts[k:upto], sizes[k:upto], 0, seed) + sizes[k:upto].astype(np.uint64))
        k = upto
    return out


def _added(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int, seed: int) -> np.ndarray:
    """The sums over the chunks of each word. chunk: the number of the first one."""
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
    place = at - np.repeat(starts, sizes)
    values = _table(seed)[(place & (CHUNK - 1)) << 8 | data[at]]
    if sizes.max(initial=0) <= CHUNK:
        return mix(np.add.reduceat(values, first) + np.uint64(chunk) * _STEP)
    counts = -(-sizes // CHUNK)
    top = np.cumsum(counts) - counts
    number = np.arange(int(counts.sum())) - np.repeat(top, counts)
    sums = np.add.reduceat(values, np.repeat(first, counts) + CHUNK * number)
    return np.add.reduceat(mix(sums + (number + chunk).astype(np.uint64) * _STEP), top)


def _long_hash(word: np.ndarray, seed: int) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for at in range(0, len(word), HASH_BYTES):
        part = word[at : at + HASH_BYTES]
        total += _added(part, np.zeros(1, np.int64), np.array([len(part)]), at // CHUNK, seed)
    return mix(total + np.uint64(len(word)))[0]
