"""Benchmark decontamination with a stored, distributed positional inverted index.

`index_documents` gives the training texts' postings as a table: for every block of documents and every
term the ascending positions at which the block holds it. Given a filter of the test items' terms, it leaves
out what no item can ask for; without one, any benchmark can be looked up in it. Test items are cut into windows of words by Spark; a window's terms are put in order from the
rarest over the whole corpus to the most common one. The rarest term's list gives the places where the
window could start, the next one's list, shifted by the distance between the two, is intersected with it,
and what is left is looked up in the lists of all other terms at once. With `slop` 0 that gives exact
phrases; with more, every other term may stand up to `slop` words from where the rarest one puts it.

All of it are joins of tables, on terms and on (block, term): neither items nor texts pass through the
driver, and a benchmark may have any size. Terms are stored and compared as text; only inside a block are
a term's places brought together by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .storage import Stash, cut, kept, unused

WINDOW = 10
#: About so many bytes of text form a block of the index; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Positions skipped between the documents of a block, so that no window reaches from one into the next.
GAP = 1024
#: Size of the filter that keeps other terms than the test items' out of an index; it is the same for any benchmark.
FILTER_BITS = 1 << 23
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def digest(text: Column) -> Column:
    """What tells texts apart besides doc_id; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def term_filter(windows: DataFrame) -> np.ndarray:
    """Bits set at the hashes of all terms of (terms); terms it lets through by chance are harmless.

    Terms are hashed in tasks and their bits put together by Spark, so the driver gets FILTER_BITS bits at most.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column("term"))
            hashed = blocks.byte_hash(data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array((hashed % np.uint64(FILTER_BITS)).astype(np.int64))], ["p"])

    places = windows.select(F.explode("terms").alias("term")).distinct().mapInArrow(place, "p long")
    parts = places.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / 32768 rows
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def index_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, only: np.ndarray | None = None) -> DataFrame:
    """The index of docs (doc_id, text), to be written once and read by `matches_of`; only: a `term_filter`.

    Rows with a term are postings: (block, term, n, positions). Rows without are documents: (block, doc_id,
    digest, first, n_words), first being the position of its first word. Words are runs of ASCII letters (A-Z
    folded), digits and characters above ASCII; null and empty texts have none.
    """
    blocks.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "term", "n", "positions", "doc_id", "digest", "first", "n_words"]
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column("text"))
            ids, digests = batch.column("doc_id"), batch.column("digest")
            for i, j in blocks.slices(offsets, block_bytes):
                own = blocks.fold_case(data[offsets[i] : offsets[j]])
                start, end, at = blocks.word_places(own, offsets[i : j + 1] - offsets[i], blocks.PLAIN_WORDS)
                row = np.repeat(np.arange(j - i), np.diff(at))
                places = (np.arange(len(start)) + row * GAP).astype(np.int32)
                count = pa.array(np.diff(at).astype(np.int32))
                first = pa.array((at[:-1] + np.arange(j - i) * GAP).astype(np.int32))
                own_block = pa.array(np.full(j - i, block))
                none = [pa.nulls(j - i, x) for x in (pa.string(), pa.int32(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([own_block, *none, ids.slice(i, j - i), digests.slice(i, j - i), first, count], names)
                hashed = blocks.byte_hash(own, start, end)
                if shared is not None:
                    p = hashed % np.uint64(FILTER_BITS)
                    asked = np.flatnonzero(shared.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
                    start, end, places, hashed = start[asked], end[asked], places[asked], hashed[asked]
                order = np.argsort(hashed, kind="stable")
                new = np.ones(len(order), bool)
                new[1:] = hashed[order][1:] != hashed[order][:-1]
                edge = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
                shown = order[edge[:-1]]
                length = end[shown] - start[shown]
                ends = np.append(0, np.cumsum(length)).astype(np.int32)
                letters = own[np.repeat(start[shown] - ends[:-1], length) + np.arange(ends[-1])]
                terms = pa.StringArray.from_buffers(len(shown), pa.py_buffer(ends), pa.py_buffer(letters))
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(places[order]))
                none = [pa.nulls(len(shown), x) for x in (ids.type, pa.string(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shown), block)), terms, pa.array(np.diff(edge)), lists, *none], names)
                block += 1

    schema = f"block long, term string, n int, positions array<int>, doc_id {kind}, digest string, first int, n_words int"
    return docs.select("doc_id", "text", digest(F.col("text")).alias("digest")).mapInArrow(read, schema)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id string, terms): the distinct windows of each item; one of fewer words, but not none, is one window."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda k: F.slice("words", k, size))).alias("terms")).distinct()


def _shifted(positions: Column, by: Column) -> Column:
    return F.transform(positions, lambda p: p - by)


def _near(starts: Column, other: Column, slop: int) -> Column:
    """The starts that have a member of other within slop."""
    if not slop:
        return F.array_intersect(starts, other)
    return F.filter(starts, lambda s: F.exists(other, lambda p: F.abs(p - s) <= slop))


def _rarest_first(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(wid, length, terms): terms as (n, place, term), rarest in the corpus first, of windows whose terms all occur."""
    placed = windows.select("wid", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    counts = postings.select("term", "n").join(windows.select(F.explode("terms").alias("term")).distinct(), "term")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
    ordered = placed.join(counts, "term").groupBy("wid", "length").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("terms"))
    return ordered.where(F.size("terms") == F.col("length"))  # `size` terms a window


def _occurrences(plans: DataFrame, postings: DataFrame, slop: int, stash: Stash) -> DataFrame:
    """(block, wid, start): where all terms of a window stand, start counted from its rarest term."""
    term = lambda k, c: F.get("terms", F.lit(k))[c]
    rare = plans.select("wid", "length", term(0, "term").alias("term"), term(0, "place").alias("place"), term(1, "term").alias("next"), term(1, "place").alias("next_place"))
    found = postings.select("block", "term", "positions").join(rare, "term").select("block", "wid", "length", "next", "next_place", _shifted(F.col("positions"), F.col("place")).alias("starts"))
    second = postings.join(rare.select(F.col("next").alias("term")).distinct(), "term", "left_semi").select("block", F.col("term").alias("next"), F.col("positions").alias("others"))
    both = found.join(second, ["block", "next"]).withColumn("starts", _near(F.col("starts"), _shifted(F.col("others"), F.col("next_place")), slop))
    both = stash.keep(both.where("size(starts) > 0").select("block", "wid", "length", F.explode("starts").alias("start")))
    rest = plans.where("length > 2").select("wid", F.explode(F.slice("terms", 3, 2**31 - 1)).alias("t")).select("wid", "t.place", "t.term")
    at = F.col("start") + F.col("place")
    needs = both.join(rest, "wid").select("block", "wid", "length", "start", "place", "term", F.explode(F.sequence(at - slop, at + slop)).alias("at"))
    want = needs.groupBy("block", "term").agg(F.collect_set("at").alias("want"))  # no more than the block's positions
    have = postings.select("block", "term", "positions").join(want, ["block", "term"]).select("block", "term", F.explode(F.array_intersect("want", "positions")).alias("at"))
    full = needs.join(have, ["block", "term", "at"]).groupBy("block", "wid", "start", "length").agg(F.count_distinct("place").alias("places"))
    single = found.where("length = 1").select("block", "wid", F.explode("starts").alias("start"))
    return single.unionByName(both.where("length = 2").select("block", "wid", "start")).unionByName(full.where("places = length - 2").select("block", "wid", "start"))


def matches_of(index: DataFrame, items: DataFrame, slop: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(block, first, doc_id, start, length, wid) of each occurrence of a window of items, and (wid, item_id).

    start and length are the occurrence's words in the document. index and items (as `item_windows` gives
    them) are read several times, so they should be stored tables. What is returned reads the stash.
    """
    windows = stash.keep(items.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()))
    postings = index.where("term IS NOT NULL")
    plans = stash.keep(_rarest_first(windows, postings))
    hits = _occurrences(plans, postings, slop, stash)
    hits = hits.join(plans.select("wid", "length", F.get("terms", F.lit(0))["place"].alias("place")), "wid")
    docs = index.where("term IS NULL").select("block", F.col("first").alias("at"), F.struct("first", "doc_id", "n_words").alias("doc"))
    held = hits.select("block", (F.col("start") + F.col("place")).alias("at"), "start", "length", "wid")
    # each hit belongs to the last document that begins before its rarest term
    line = Window.partitionBy("block").orderBy(F.col("at"), F.col("wid").isNotNull())  # the documents and hits of one block
    both = docs.unionByName(held, allowMissingColumns=True).withColumn("doc", F.last("doc", ignorenulls=True).over(line)).where("wid IS NOT NULL")
    start = F.greatest(F.lit(0), F.least(F.col("start") - F.col("doc.first"), F.col("doc.n_words") - F.col("length")))
    found = both.select("block", "doc.first", "doc.doc_id", start.cast("long").alias("start"), F.col("length").cast("long").alias("length"), "wid")
    return stash.keep(found), stash.keep(items.join(windows, "terms").select("wid", "item_id"))


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id string, start long, n_words long): each occurrence of a window of an item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts hold no
    words and items without words have no window; an item shorter than `size` is one window. Repeated
    documents or items each count; equal windows of many items are matched once and reported for each item.
    """
    if not (0 < size and 0 <= slop and size + slop < GAP):
        raise ValueError(f"size and slop must lie below {GAP} together")
    with Stash(docs.sparkSession) as stash:
        items = stash.keep(item_windows(benchmark, size))
        found, owners = matches_of(stash.keep(index_documents(docs, block_bytes, term_filter(items)), {"parquet.enable.dictionary": "false"}), items, slop, stash)
        return cut(found.join(owners, "wid").select("doc_id", "item_id", "start", F.col("length").alias("n_words")))


def judged(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items) for each row of docs, without its text.

    n_hit counts words inside any occurrence of any item's window, overlaps once; items are the ids of
    items with occurring windows as sorted strings. Same input rules as `find_matches`; items without id
    count for n_hit but are not named. Without benchmark or documents nothing is hit.
    """
    with Stash(docs.sparkSession) as stash:
        items = stash.keep(item_windows(benchmark, size))
        index = stash.keep(index_documents(docs, block_bytes, term_filter(items)), {"parquet.enable.dictionary": "false"})
        found, owners = matches_of(index, items, 0, stash)
        spans = found.select("block", "first", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
        before = Window.partitionBy("block", "first").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
        covered = spans.withColumn("fresh", fresh).groupBy("block", "first").agg(F.sum("fresh").alias("n_hit"))
        named = found.select("block", "first", "wid").distinct().join(owners, "wid").where("item_id IS NOT NULL")
        named = named.groupBy("block", "first").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        rows = index.where("term IS NULL").select("block", "first", "doc_id", "digest", F.col("n_words").cast("long").alias("n_words"))
        rows = rows.join(covered.join(named, ["block", "first"], "left"), ["block", "first"], "left")
        return cut(rows.select("doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: all its columns and n_words, n_hit, items, as `judged` gives them.

    Repeated rows are judged alike. Clashing column names are refused.
    """
    if clash := {"n_words", "n_hit", "items", "digest"} & {*docs.columns}:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    of, by = unused(docs, "_doc_id", "_digest")
    told = judged(docs, benchmark, size, block_bytes).dropDuplicates(["doc_id", "digest"]).withColumnsRenamed({"doc_id": of, "digest": by})
    return docs.join(told, _same(of, by)).select(*docs.columns, "n_words", "n_hit", "items")


def _same(of: str, by: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(of)) & (digest(F.col("text")) == F.col(by))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns, whatever their names."""
    of, by = unused(docs, "_doc_id", "_digest")
    hit = judged(docs.select("doc_id", "text"), benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias(of), F.col("digest").alias(by))
    return docs.join(kept(hit), _same(of, by), "left_anti")  # whether texts are shuffled depends on how many are hit


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of `judged` over whole documents and benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
