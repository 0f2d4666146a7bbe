"""Ranked lexical search without an index of documents: an Aho-Corasick automaton reads the texts themselves.

The terms of all items, each between two blanks as guards, are the automaton's patterns; texts are put into
the form in which every character that belongs to no term is a blank. One pass over the texts counts in
how many documents each pattern occurs, a second one scores: the automaton's outputs are term numbers,
which map to the items that hold the term. A task keeps the best `k` documents of each item as it goes, so
only those are shuffled, whatever the number of documents.

Items are taken in blocks of about ITEM_BYTES of text, so what is broadcast and collected is bounded; a
larger set of items costs one more pair of passes for each block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .storage import Stash, cut

BEST = 10
#: Text of the items that are looked for in one pass; a longer item is a block of its own.
ITEM_BYTES = 4 << 20
#: Scores of (document, item) that a task holds at once.
CELLS = 1 << 21
#: Kept documents of a task before it cuts them down to the best of each item.
POOL = 1 << 18
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CLASS = blocks.word_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def terms_of(items: DataFrame) -> DataFrame:
    """(key, item_id, terms, n_bytes): each row's distinct terms; rows without any are left out."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(low, F.lit(_TERM), F.lit(0)))
    rows = items.select("item_id", terms.alias("terms")).where("size(terms) > 0")
    return rows.withColumns({"key": F.monotonically_increasing_id(), "n_bytes": F.octet_length(F.array_join("terms", " "))})


class Wanted:
    """A block of items: numbers of its terms, and for each term the items that hold it."""

    def __init__(self, rows: list):
        self.keys = np.array([r.key for r in rows], np.int64)
        self.terms = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(self.terms)}
        held = sorted((number[t], i) for i, r in enumerate(rows) for t in r.terms)
        self.items = np.array([i for _, i in held], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in held]), np.arange(len(self.terms) + 1))
        self.weights, self.documents, self.total, self.id = np.zeros(0, np.int64), 0, 0, uuid.uuid4().hex

    def weighted(self, counts: dict[int, int]) -> Wanted:
        """With weights from the documents that hold each term (-1: that hold any, -2: their terms in all)."""
        self.documents, self.total = counts.get(-1, 0), counts.get(-2, 0)
        self.weights = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)
        return self


_automata: dict = {}


def _automaton(wanted: Wanted):
    """The automaton of a block, built once in a worker."""
    import ahocorasick

    if wanted.id not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for number, term in enumerate(wanted.terms):
            made.add_word(f" {term} ", number)
        made.make_automaton()
        _automata[wanted.id] = made
    return _automata[wanted.id]


def _counted(batch: pa.RecordBatch, wanted: Wanted) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of a batch: (row, n terms) of documents with terms, and (which of those, term, tf) of what is found."""
    automaton, size = _automaton(wanted), len(wanted.terms)
    data, offsets = blocks.text_bytes(batch.column("text"))
    for i, j in blocks.slices(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, _, first = blocks.word_places(own, at, _CLASS)
        n = np.diff(first)
        rows = np.flatnonzero(n)
        raw = np.where(_CLASS[own], blocks.fold_case(own), np.uint8(32)).tobytes()
        found = []
        for k, r in enumerate(rows.tolist()):
            base = k * size
            found += [base + t for _, t in automaton.iter(f" {raw[at[r] : at[r + 1]].decode()} ")]
        keys, tf = np.unique(np.array(found, np.int64), return_counts=True)
        yield rows + i, n[rows], keys // size, keys % size, tf


def document_counts(docs: DataFrame, wanted) -> DataFrame:
    """(term, n): documents that hold each term of a broadcast block; -1 counts documents with terms, -2 all their terms."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = wanted.value
        df, total = np.zeros(len(block.terms), np.int64), [0, 0]
        for batch in batches:
            for rows, n, _, term, _ in _counted(batch, block):
                df += np.bincount(term, minlength=len(df))
                total = [total[0] + len(rows), total[1] + int(n.sum())]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append(total, df[some]))], ["term", "n"])

    return docs.select("text").mapInArrow(read, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Best:
    """The best documents of each item so far: highest score first, then least id, documents without id last."""

    def __init__(self, items: int, k: int, pool: int = POOL):
        self.k, self.pool, self.floor = k, pool, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, whether without id, id

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        self.rows = np.hstack([self.rows, np.stack([item, scores[doc, item], no_id[doc], ids[doc]])])
        if self.rows.shape[1] > self.pool:
            self.cut()

    def cut(self) -> np.ndarray:
        item, score, no_id, ids = self.rows
        order = np.lexsort((ids, no_id, -score, item))
        ranked = item[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        self.floor[ranked[rank == self.k - 1]] = score[order[rank == self.k - 1]]
        self.rows = self.rows[:, order[rank < self.k]]
        return self.rows


def scored(docs: DataFrame, wanted, k: int, cells: int = CELLS) -> DataFrame:
    """(key, doc_id, score): for each task the best k documents of each item of a broadcast block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = wanted.value
        items, best = len(block.keys), _Best(len(block.keys), k)
        for batch in batches:
            ids, no_id = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for rows, n, doc, term, tf in _counted(batch, block):
                m = np.array([10 + 90 * x * block.documents // block.total for x in n.tolist()], np.int64)
                share = block.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                step = max(1, cells // items)
                for a in range(0, len(rows), step):
                    x, y = np.searchsorted(doc, [a, a + step])
                    each = block.first[term[x:y] + 1] - block.first[term[x:y]]
                    place = np.repeat(block.first[term[x:y]] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    sums = np.zeros(min(step, len(rows) - a) * items, np.int64)
                    np.add.at(sums, np.repeat((doc[x:y] - a) * items, each) + block.items[place], np.repeat(share[x:y], each))
                    best.add(sums.reshape(-1, items), ids[rows[a : a + step]], no_id[rows[a : a + step]])
        item, score, without, doc_id = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[item]), pa.array(doc_id, mask=without.astype(bool)), pa.array(score)], ["key", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "key long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES, cells: int = CELLS) -> DataFrame:
    """(item_id, rank int, doc_id long, score long): the k best documents of each row of items.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have no
    terms: such documents count nowhere, such items have no rows. Every row is a document or an item of its
    own, repeated ones too. Equal scores rank by doc_id, documents without id last. Scores of 0 are left out.
    """
    spark = docs.sparkSession
    blocks.small_batches(spark)
    with Stash(spark) as stash:
        rows = stash.keep(terms_of(items))
        size = rows.agg(F.sum("n_bytes")).first()[0] or 0
        parts = 1 if size <= item_bytes else -(-2 * size // item_bytes)
        found = None
        for part in range(parts):
            block = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key", "terms").collect()  # about item_bytes
            if not block:
                continue
            wanted = Wanted(block)
            counts = document_counts(docs, spark.sparkContext.broadcast(wanted)).collect()  # a row for each term of the block
            if not (counts := {r.term: r.n for r in counts}).get(-1):
                break
            some = scored(docs, spark.sparkContext.broadcast(wanted.weighted(counts)), k, cells)
            found = some if found is None else found.unionByName(some)
        if found is None:
            return cut(rows.limit(0).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score"))
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return cut(top.join(rows.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score"))


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each item of benchmark."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
