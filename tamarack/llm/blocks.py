"""Whole texts as byte buffers: tokens, their hashes and shingles with numpy, for use inside Spark tasks.

A task sees its rows as Arrow batches. Texts of a batch are taken in slices of about a MB, so memory
stays bounded whatever the batch holds; a single text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(2**31 - 1)
_RNG = np.random.Generator(np.random.PCG64(20240201))
_BYTE = _RNG.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_BASES = tuple(_RNG.integers(2**20, 2**31 - 1, 2).tolist())
_powers: dict[int, np.ndarray] = {}
_wrapped: dict[int, np.ndarray] = {}
#: Strings of up to 8 * EIGHTS bytes are hashed in eights, longer ones by digest.
EIGHTS = 4
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that nearby inputs spread over the whole range."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2**31 - 1, for x below 2**63."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**31 - 1."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _modulo(have * np.uint64(pow(base, len(have), int(_PRIME))))])
    _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> list[np.ndarray]:
    """For each of two bases, c with c[i] the sum of the first i bytes' values, each times a power of its place."""
    out = []
    for base in _BASES:
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_modulo(_BYTE[data] * powers(base, len(data))), out=c[1:])
        out.append(c)
    return out


def span_hash(c: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes have equal hashes wherever they stand.

    Two polynomials modulo the prime 2**31 - 1: two spans of n bytes agree by chance once in (2**31 / n)**2.
    """
    one, two = (_modulo(_modulo(x[ends] - x[starts]) * powers(pow(base, -1, int(_PRIME)), len(x))[starts]) for x, base in zip(c, _BASES, strict=True))
    return mix((one << np.uint64(31) | two) ^ ((ends - starts).astype(np.uint64) * _MULT))


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of the `size` bytes from each place on, for choosing among places.

    A polynomial modulo 2**64: equal bytes have equal hashes, but equal hashes prove nothing.
    """
    base = 0xD1342543DE82EF95
    have = _wrapped.get(base)
    if have is None or len(have[0]) <= len(data):
        steps = np.full((2, max(len(data) + 1, SLICE + (1 << 16))), base, np.uint64)
        steps[1] = pow(base, -1, 1 << 64)
        steps[:, 0] = 1
        have = _wrapped[base] = np.multiply.accumulate(steps, axis=1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[data] * _MULT) * have[0][: len(data)], out=c[1:])
    n = max(0, len(data) - size + 1)
    return mix((c[size:] - c[:n]) * have[1][:n]) if n else np.zeros(0, np.uint64)


def word_class(separators: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words between blanks, and words of ASCII letters, digits and all other characters above ASCII.
BLANK_WORDS = word_class(bytes([0x20, *range(0x09, 0x0E)]))
PLAIN_WORDS = word_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_places(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and n + 1 offsets of the rows' words."""
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _FOLD[data]


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short byte strings: eight bytes a step, each step mixed over the whole range.

    Strings beyond EIGHTS steps take a BLAKE2 digest, so no choice of text makes two of them alike.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = mix((eight[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _MULT)
    for k in range(8, 8 * EIGHTS, 8):
        on = np.flatnonzero(size > k)
        if not len(on):
            break
        h[on] = mix(h[on] * _MULT ^ mix(eight[starts[on] + k] & _LOW[np.minimum(size[on] - k, 8)]))
    for i in np.flatnonzero(size > 8 * EIGHTS).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word after folding A-Z, and n + 1 offsets of the rows' words."""
    data = fold_case(data)
    starts, ends, at = word_places(data, offsets, table)
    return byte_hash(data, starts, ends), at


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, ascending, with n + 1 offsets; fewer words make one shingle."""
    counts = np.diff(offsets)
    grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        grams += hashes[j : len(hashes) - k + 1 + j] * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(len(hashes) - k + 1) + k <= offsets[1:][row[: len(grams)]] if len(grams) else np.zeros(0, bool)
    rows, values = [row[: len(grams)][whole]], [mix(grams[whole])]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[offsets[i] : offsets[i + 1]]
        value = sum(int(h) * pow(0xE7037ED1A0B428DB, j + 1, 1 << 64) for j, h in enumerate(own)) + len(own)
        rows.append(np.array([i]))
        values.append(mix(np.array([value & (2**64 - 1)], np.uint64)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))
