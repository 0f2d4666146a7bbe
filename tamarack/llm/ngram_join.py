"""N-gram Jaccard self-join by T-occurrence search.

Two sets of sizes x and y with Jaccard likeness t or more share T = ceil(t (x + y) / (1 + t)) members.
Inverted lists map a shingle to the sets that hold it. As in DivideSkip, lists are divided into short
and long ones, in one order of all shingles: those found to be frequent come last. A set enters the
lists of its first |x| - ceil(t |x|) + 1 shingles in that order only, so long lists are met only by
sets that consist of little else. Spark's shuffle by shingle merges the lists: hits of a pair are
counted over the lists that hold both, and a pair stays when its hits and what either set holds beyond
its listed part can reach T. The rest of each set, long lists included, is then probed: the shorter
set's members are looked up by binary search in the other's sorted members, which settles the overlap.

Sets are taken once per distinct set, so exact copies cost one entry however many there are. Lists of
near copies would still give all pairs of a group; so each list first gives only its members' pairs
with one leader, and after links from these pairs have merged most of a group into one component, only
pairs between different components of a list are left to look at. Of short lists these become rows;
members of a long list are dealt out in blocks, and each two blocks are searched by DivideSkip in a
task of their own, which returns no more links than join components. No pair is skipped otherwise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .graph import components
from .storage import Stash, cut, kept, unused

WORDS = 5
PERCENT = 80
#: A shingle counts as frequent from this many copies seen within single tasks' stretches of documents.
FREQUENT = 32
#: At most so many frequent shingles are sent to tasks (8 bytes each); the rarer ones count as short.
MOST_FREQUENT = 1 << 18
STRETCH = 4_000_000
FILTER_BITS = 1 << 24
#: Lists of so many entries or more are searched in blocks of members instead of giving rows of pairs.
LONG_LIST = 128
BLOCK = 512


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = blocks.text_bytes(batch.column("text"))
    for i, j in blocks.slices(offsets):
        h, at = blocks.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks.BLANK_WORDS)
        yield i, j, *blocks.shingles(h, at, words)


def _names(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set, from its members and its size."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(blocks.mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=c[1:])
    size = np.diff(offsets).astype(np.uint64)
    return blocks.mix(c[offsets[1:]] - c[offsets[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, name) of each document, and (s, n): frequent shingles with copies seen."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        seen, held = [], 0
        ids = pa.array([], pa.int64())

        def frequent():
            values, n = np.unique(np.concatenate(seen), return_counts=True)
            values, n = values[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), ids.type), pa.array(n.astype(np.int64)), pa.array(values.view(np.int64)), pa.array(np.ones(len(n), bool))], ["doc_id", "n", "name", "listed"])

        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, values, offsets in _sets(batch, words):
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size), pa.array(_names(values, offsets)), pa.array(np.zeros(j - i, bool))], ["doc_id", "n", "name", "listed"])
                seen.append(values)
                held += len(values)
                if held > STRETCH:
                    yield frequent()
                    seen, held = [], 0
        if seen:
            yield frequent()

    both = cut(docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, name long, listed boolean"))
    counts = both.where("listed").groupBy(F.col("name").alias("s")).agg(F.sum("n").alias("n"))
    return both.where("not listed").select("doc_id", "n", "name"), counts


def _frequent(counts: DataFrame) -> np.ndarray:
    """The frequent shingles, at most MOST_FREQUENT: the least power of two that leaves so few is the bound."""
    level = F.floor(F.log2("n")).cast("int")
    many = cut(counts.where(F.col("n") >= FREQUENT))
    sizes = {r.level: r["count"] for r in many.groupBy(level.alias("level")).count().collect()}
    bound, total = 64, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > MOST_FREQUENT:
            break
        bound, total = k, total + sizes[k]
    return np.sort(np.array(many.where(level >= bound).select("s").toArrow().column("s").to_numpy()).view(np.uint64))


def _listed(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def inverted_lists(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(s, name, n, i): entries of each set's first shingles, i from 0, rare ones before frequent ones."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def enter(batches):
        hot = shared.value
        for batch in batches:
            done: set = set()
            for _, _, values, offsets in _sets(batch, words):
                n = np.diff(offsets)
                names = _names(values, offsets)
                row = np.repeat(np.arange(len(n)), n)
                if len(hot):
                    at = np.searchsorted(hot, values)
                    at[at == len(hot)] = 0
                    order = np.lexsort((values, hot[at] == values, row))
                    values = values[order]
                new = np.array([not (x in done or done.add(x)) for x in names.tolist()], bool)
                place = np.arange(len(values)) - offsets[:-1][row]
                take = new[row] & (place < _listed(n, percent)[row])
                yield pa.RecordBatch.from_arrays([pa.array(values[take].view(np.int64)), pa.array(names[row[take]]), pa.array(n[row[take]].astype(np.int32)), pa.array(place[take].astype(np.int32))], ["s", "name", "n", "i"])

    return docs.select("text").mapInArrow(enter, "s long, name long, n int, i int")


def members(docs: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """(name, shingles): sorted members of the named sets, one row each.

    A bitmap of fixed size tells tasks which sets are wanted; sets it lets through by chance are harmless.
    """
    place = F.pmod("name", F.lit(FILTER_BITS))
    parts = names.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in parts.collect():  # FILTER_BITS / 32768 rows at most
        start = (r.k - 1) * 4096 if r.k > 0 else 0
        bits[start : start + 4096] |= np.frombuffer(r.bits, np.uint8)
    # bucket k holds the places from (k - 1) * 32768 + 1 on; place 0 has bucket 0
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches):
        for batch in batches:
            done: set = set()
            for _, _, values, offsets in _sets(batch, words):
                name = _names(values, offsets)
                p = name % FILTER_BITS
                at = np.maximum(p - 1, 0)
                wanted = (np.diff(offsets) > 0) & ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | (p == 0)
                rows = [k for k in np.flatnonzero(wanted & (np.diff(offsets) > 0)).tolist() if not (name[k] in done or done.add(name[k]))]
                if rows:
                    sets = [np.sort(values[offsets[k] : offsets[k + 1]].view(np.int64)) for k in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(name[rows]), pa.array(sets, pa.list_(pa.int64()))], ["name", "shingles"])

    found = docs.select("text").mapInArrow(read, "name long, shingles array<long>")
    return found.join(names, "name", "left_semi").dropDuplicates(["name"])


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of rows (name, n, i, b, m, j), one for each list that holds both, that can still reach T.

    T is the overlap that sizes n and m need. Beyond its hits a pair can only share what follows the
    last listed part of either set, and no more than follows any shared shingle in both sets. That holds
    for all hits of a pair together, so rows are turned to one direction first.
    """
    turned = F.col("name") > F.col("b")
    sides = {"a": ("name", "b"), "b": ("b", "name"), "n": ("n", "m"), "m": ("m", "n"), "i": ("i", "j"), "j": ("j", "i")}
    rows = rows.select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(k) for k, (x, y) in sides.items()])
    need = F.expr(f"({percent} * (n + m) + {percent + 99}) div {percent + 100}")
    near = rows.where(f"100 * n >= {percent} * m AND 100 * m >= {percent} * n")
    hits = near.groupBy("a", "n", "b", "m").agg(F.count(F.lit(1)).alias("hits"), F.max("i").alias("i"), F.max("j").alias("j"))
    beyond = F.least(F.floor((F.greatest("n", "m") * percent + 99) / 100) - 1, F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return hits.where(F.col("hits") + beyond >= need).select("a", "b")


def probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets share T members or more."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("y"))

    def probe(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[k].values) for c in "xy")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(probe, "a long, b long")


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A set is the distinct `words`-word shingles of a text (words between blanks, A-Z folded); fewer
    words are one shingle; null texts and texts without words have no set, link with nothing and are
    their own component. Sets link at `percent` of their union or more; component_id is the least
    doc_id that links reach. Rows with the same doc_id are separate nodes of that name; rows without a
    doc_id take part and get their component's least id, null if it has none. doc_id may be of any
    ordered type, other columns are ignored, and without rows there are no rows.
    """
    spark = docs.sparkSession
    blocks.small_batches(spark)
    named, counts = shingle_sets(docs, words)
    with Stash(spark) as stash:
        entries = inverted_lists(docs, _frequent(counts), words, percent).repartition("s").dropDuplicates(["s", "name", "n", "i"])
        own = Window.partitionBy("s")
        lists = stash.keep(entries.withColumn("size", F.count(F.lit(1)).over(own)).where("size > 1"))
        leaders = [F.min(F.struct(F.xxhash64("name", F.lit(k)).alias("rank"), F.col("name").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))).over(own) for k in (1, 2)]
        star = lists.withColumns({"one": leaders[0], "two": leaders[1]})
        star = star.select("name", "n", "i", F.expr("name IN (one.b, two.b)").alias("led"), F.explode(F.array_distinct(F.transform(F.array("one", "two"), lambda x: x.dropFields("rank")))).alias("lead"))
        star = star.where("name <> lead.b AND (name > lead.b OR NOT led)")  # two leaders are one pair
        star = cut(_pairs(star.select("name", "n", "i", "lead.*"), percent))
        links = cut(probed(star, members(docs, _named(star), words), percent))
        rest = stash.keep(_apart(lists, components(links)))
        long = rest.where(F.col("size") >= LONG_LIST)
        if not long.isEmpty():
            links = links.unionByName(cut(_block_links(long, members(docs, long.select("name").distinct(), words), percent)))
        # the largest component of a list needs no pairs of its own: all others meet it and each other
        rest = rest.where(F.col("size") < LONG_LIST)
        mate = rest.select("s", F.col("name").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"), F.col("main").alias("b_main"))
        pairs = rest.join(mate, "s").where("root <> other AND NOT main AND (b_main OR name < b)")
        pairs = cut(_pairs(pairs.select("name", "n", "i", "b", "m", "j"), percent).join(star, ["a", "b"], "left_anti"))
        roots = cut(components(links.unionByName(probed(pairs, members(docs, _named(pairs), words), percent))))
    joined = named.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    full = joined.where("n > 0")
    ids = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(ids, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of lists that still hold two components or more, with root and whether it is the list's main one."""
    known = lists.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    own = Window.partitionBy("s")
    known = known.withColumns({"lo": F.min("root").over(own), "hi": F.max("root").over(own)}).where("lo <> hi").drop("lo", "hi")
    sizes = known.groupBy("s", "root").agg(F.count(F.lit(1)).alias("of"))
    main = sizes.groupBy("s").agg(F.max(F.struct("of", "root"))["root"].alias("top"))
    return known.join(main, "s").withColumn("main", F.col("root") == F.col("top")).drop("top")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()


def divide_skip(sets: list[np.ndarray], roots: list[int], split: int, percent: int) -> list[tuple[int, int]]:
    """Links (x, y), x < split <= y, or x < y where split is 0, that join sets of different roots.

    For each set x the lists of its members are divided: the longest L are put aside, the others are
    merged by a heap. Sets that come out T - L times or more are probed in the long lists by binary search.
    Of links that join the same roots over again one is returned.
    """
    first = split if split else len(sets)
    others = range(split, len(sets))
    size = np.array([len(s) for s in sets])
    values = np.concatenate([sets[k] for k in others])
    holder = np.repeat(np.arange(len(sets))[split:], size[split:])
    order = np.argsort(values, kind="stable")
    values, holder = values[order], holder[order]
    group = np.unique(np.asarray(roots), return_inverse=True)[1]
    out = []
    for x in range(first):
        open_ = group != group[x]  # what is joined to x already needs no link
        open_[: split if split else x + 1] = False
        open_ &= (100 * size >= percent * size[x]) & (100 * size[x] >= percent * size)
        if not open_.any():
            continue
        lo, hi = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], side="right")
        need = -(-percent * (size[x] + size) // (percent + 100))
        aside = int(min(need[open_].min() - 1, size[x] - 1))
        by = np.argsort(hi - lo)
        short, long = by[: len(by) - aside], by[len(by) - aside :]
        # heap-merge of the short lists: holders come out in order, equal ones together
        lists = [h[open_[h]].tolist() for h in (holder[a:b] for a, b in zip(lo[short], hi[short], strict=True) if a < b)]
        count = np.bincount(np.fromiter(heapq.merge(*lists), np.int64), minlength=len(sets))
        for y in np.flatnonzero((count > 0) & (count >= need - aside)).tolist():
            if group[x] != group[y]:
                where = np.minimum(np.searchsorted(sets[y], sets[x][long]), size[y] - 1)
                if count[y] + int((sets[y][where] == sets[x][long]).sum()) >= need[y]:
                    group[group == group[y]] = group[x]
                    out.append((x, y))
    return out


def _block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of long lists (s, name, root, size): blocks of members, two at a time."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rest.select("s", "name", "root", n.alias("blocks")).withColumn("block", F.pmod(F.hash("name"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("s", "name", "root", "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y")).join(sets, "name")

    def search(key, pdf):
        pdf = pdf.sort_values(["block", "name"], ignore_index=True)
        split = 0 if key[1] == key[2] else int((pdf["block"] == key[1]).sum())
        if len(pdf) < 2 or (key[1] != key[2] and split in (0, len(pdf))) or pdf["root"].nunique() < 2:
            return pdf[["name", "root"]].head(0).rename(columns={"name": "a", "root": "b"})
        links = divide_skip([np.asarray(x) for x in pdf["shingles"]], pdf["root"].tolist(), split, percent)
        name = pdf["name"].to_numpy()
        return pdf[["name", "root"]].head(0).rename(columns={"name": "a", "root": "b"}) if not links else type(pdf)({"a": name[[x for x, _ in links]], "b": name[[y for _, y in links]]})

    return rows.groupBy("s", "x", "y").applyInPandas(search, "a long, b long")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that of the least doc_id, of equal ids the one whose text has the least digest.

    Rows without a set stay, as do all rows that nothing links; of rows alike in doc_id and text one stays.
    Rows with and without doc_id take part alike, those with one being preferred.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    linked = link_components(docs.select(key.alias("doc_id"), "text"), words, percent)
    linked = cut(linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies")))
    of, by = unused(docs, "_doc_id", "_digest")
    named = [F.col("doc_id.id").alias(of), F.col("doc_id.digest").alias(by)]
    gone = kept(linked.where("copies > 1 OR doc_id <> component_id").select(named))
    again = kept(linked.where("copies > 1 AND doc_id = component_id").select(named))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(by))
    one = docs.join(again, same).dropDuplicates([of, by]).select(docs.columns)
    return docs.join(gone, same, "left_anti").unionByName(one)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """`link_components` over whole documents: 5-word shingles, likeness 0.8."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
