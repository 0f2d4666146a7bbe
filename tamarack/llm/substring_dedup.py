"""Repeated passages of words by level-wise doubling.

A window of `window` words can only be repeated if its halves are. So levels of growing length are gone
through: windows that stand in two documents at one length are extended to twice that length (less where
the target is not a power of two: the two halves then overlap), and only those are looked at again, until
the target length is reached or no candidate survives. Each level is one exchange of `slices`.

The first level is four words: shorter windows are nearly all repeated in prose and would prune nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .slices import Named, Slices, at_least, smaller_elsewhere, survivors, window_hashes
from .storage import cut

WINDOW = 13
FIRST = 4


def lengths(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Ascending window lengths; each is at most twice the one before, the last is window.

    >>> lengths(13, 4)
    [4, 7, 13]
    """
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


class _Words:
    """Words of a slice's texts, split at blanks: places, hashes, and each word's document."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.data, offsets = blocks.text_bytes(columns["text"])
        self.starts, self.ends, self.at = blocks.word_places(self.data, offsets, blocks.BLANK_WORDS)
        self.hashes = blocks.byte_hash(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.ids = columns["doc_id"].fill_null(0).to_numpy()
        self.known = columns["doc_id"].is_valid().to_numpy(zero_copy_only=False)

    def whole(self, length: int) -> np.ndarray:
        """Places from which `length` words of one document with an id follow."""
        if not len(self.doc):
            return np.zeros(0, np.int64)
        return np.flatnonzero((np.arange(len(self.doc)) + length <= self.at[1:][self.doc]) & self.known[self.doc])

    def extended(self, places: np.ndarray, by: int, length: int) -> np.ndarray:
        """Of the places of surviving windows those from which a window `by` words longer may be repeated too."""
        alive = np.zeros(len(self.doc) + by + 1, bool)
        alive[places] = True
        places = places[alive[places + by]]
        return places[places + length <= self.at[1:][self.doc[places]]]


def _pack(places: np.ndarray, n: int) -> bytes:
    bits = np.zeros(n, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _unpack(state: bytes, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(state, np.uint8), count=n))


def _level(levels: list[int], k: int):
    """The step of level k: candidates from the answers of the level before, named with what is asked about them.

    Before the last level that is how many documents (2 stands for more) of the slice hold a window, at the
    last one the least doc_id of those.
    """

    def step(columns, answers, state, shards):
        words = _Words(columns)
        if k == 0:
            places = words.whole(levels[0])
        else:
            before = _unpack(state, len(words.doc))
            lived = before[Named(window_hashes(words.hashes, before, levels[k - 1]), shards).answered(answers)]
            places = words.extended(lived, levels[k] - levels[k - 1], levels[k])
        named, doc = Named(window_hashes(words.hashes, places, levels[k]), shards), words.doc[places]
        if k == len(levels) - 1:
            values = named.reduced(np.minimum, words.ids[doc])
        else:
            values = 1 + (named.reduced(np.minimum, doc) != named.reduced(np.maximum, doc))
        return named, values, _pack(places, len(words.doc))

    return step


def _removal(levels: list[int], keep_text: bool, answered: bool):
    def step(columns, answers, state, shards) -> Iterator[pa.RecordBatch]:
        words = _Words(columns)
        n = len(words.doc)
        cover = np.zeros(n + 1, np.int64)
        if answered:
            places = _unpack(state, n)
            named, own = Named(window_hashes(words.hashes, places, levels[-1]), shards), words.ids[words.doc[places]]
            gone = places[named.answered(answers) | (named.reduced(np.minimum, own)[named.of] < own)]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + levels[-1], -1)
        removed = np.cumsum(cover)[:n] > 0
        # kept words on end, each followed by a blank
        kept = np.flatnonzero(~removed)
        size = words.ends[kept] - words.starts[kept] + 1
        ends = np.append(0, np.cumsum(size))
        source = np.repeat(words.starts[kept] - ends[:-1], size) + np.arange(ends[-1])
        text = np.append(words.data, np.uint8(32))[np.minimum(source, len(words.data))]
        text[ends[1:] - 1] = 32
        raw, at = text.tobytes(), ends[np.searchsorted(kept, words.at)]
        texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        edge = np.diff(removed.astype(np.int8), prepend=0)
        edge[words.at[:-1][words.at[:-1] < n]] = removed[words.at[:-1][words.at[:-1] < n]]
        first = np.flatnonzero(edge > 0)  # a run ends with its document
        stop = np.minimum(np.append(kept, n)[np.searchsorted(kept, first)], words.at[1:][words.doc[first]])
        base = words.at[words.doc[first]]
        spans = pa.StructArray.from_arrays([pa.array(first - base), pa.array(stop - base)], ["start", "stop"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, words.at).astype(np.int32)), spans)
        total = np.append(0, np.cumsum(removed))
        yield pa.RecordBatch.from_arrays(
            [
                columns["doc_id"], pa.array(np.diff(words.at)), pa.array(np.diff(total[words.at])),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts]), spans, pa.array(texts if keep_text else [None] * len(texts), pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
        )

    return step


def without_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, keep_text: bool = True, **sizes) -> DataFrame:
    """doc_id long, n_words, n_removed long, kept_sha256, spans (of removed words, from 0, end exclusive), and kept with keep_text.

    A word goes if a window that covers it also starts in a row with a smaller doc_id. Rows that share a
    doc_id do not remove each other's words; a row without doc_id neither loses words nor makes others lose
    any. Null and empty texts have no words, texts of fewer than `window` words lose none. Other columns
    are ignored. Windows are compared by 64-bit hashes besides the shard's bits.
    """
    levels, answers = lengths(window, first), None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Slices(texts, ["doc_id"], **sizes) as slices:
        for k in range(len(levels)):
            last = k == len(levels) - 1
            answers = slices.asked(answers, _level(levels, k), smaller_elsewhere if last else at_least(2), 8 if last else 4)
            if not last and not survivors(answers):
                answers = None
                break
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept string"
        out = slices.applied(answers, _removal(levels, keep_text, answers is not None), schema)
        return cut(out if keep_text else out.drop("kept"))


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of `without_repeats` over whole documents: windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, keep_text=False).drop("spans")
