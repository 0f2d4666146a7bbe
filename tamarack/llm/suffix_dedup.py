"""Repeated passages by deep-shallow sorting of a sparse, distributed suffix array.

A byte goes when it lies in a string of `length` bytes that starts anywhere else too. Sorting every
suffix would move each text hundreds of times over, so the array is sparse: of the `GRAM`-byte strings
in any stretch of `length` bytes the one with the least hash is an anchor. Equal stretches choose the
same anchor at the same offset, so every repeat shows as two anchors with equal grams and enough equal
bytes to their left and right; nothing is missed.

Suffixes that start at anchors are sorted deep-shallow: Spark's shuffle groups them by their first
GRAM bytes and drops groups of one; inside a task multikey quicksort goes on to a shallow depth, and
blind tries order what is still tied. Neighbours' common prefixes then give, for each offset o, the
runs of suffixes that agree for length - o bytes; members of a run whose last o bytes before the
anchor agree as well are repeats.

Anchors whose whole surroundings (all that any stretch through them can reach) are equal need no
sorting beyond that: they are settled by counting, and one of them stands for all in the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

LENGTH = 200
GRAM = 48
#: Depth at which multikey quicksort stops and blind tries take over: the gram, which is shared, and some bytes more.
SHALLOW = GRAM + 8
#: Suffixes sorted at once in a task; a group of equal grams is never divided.
AT_ONCE = 8_000
#: A larger group of suffixes with equal grams and different surroundings is settled by Spark's counting.
CROWD = 50_000


def _sliding(reduce: np.ufunc, x: np.ndarray, width: int, fill: int) -> np.ndarray:
    """reduce over x[i : i + width] for each i, x continued by fill."""
    n = -(-(len(x) + width) // width) * width
    padded = np.full(n, fill, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = reduce.accumulate(rows, axis=1).reshape(-1)
    back = reduce.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return reduce(back[: len(x)], ahead[width - 1 : width - 1 + len(x)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, left, right, gram, around) of the anchors of some texts.

    left and right: bytes before and from the anchor's start that a stretch through it can reach;
    gram: a hash of the anchor's gram; around: a BLAKE2 digest (two words) of all those bytes.
    """
    n, width = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    gram = blocks.gram_hash(data, GRAM)
    least = _sliding(np.minimum, gram, width, 2**64 - 1)
    valid = np.zeros(len(gram), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[a : max(a, b - length + 1)] = True
    least[~valid] = 0
    # an anchor is the least gram of a valid stretch that begins at most width - 1 before it
    most = _sliding(np.maximum, least[::-1], width, 0)[::-1]
    at = np.flatnonzero((most == gram) & (most > 0))
    row = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(at - offsets[row], length - GRAM)
    right = np.minimum(offsets[row + 1] - at, length)
    text, spans = data.tobytes(), zip((at - left).tolist(), (at + right).tolist(), left.tolist(), right.tolist(), strict=True)
    told = b"".join(hashlib.blake2b(text[a:b] + bytes((x, y)), digest_size=16).digest() for a, b, x, y in spans)
    return row, at - offsets[row], left, right, gram[at], np.frombuffer(told, "<u8").reshape(-1, 2)


def _blind_trie(strings: list[bytes]) -> list[int]:
    """Places of equally long strings in ascending order, equal strings together.

    Inner nodes are [depth, {byte: child}] and hold no text; leaves are lists of equal strings' places.
    """

    def common(x: bytes, y: bytes) -> int:
        apart = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return len(x) - (apart.bit_length() + 7) // 8

    top: list | tuple = [0]  # a leaf that holds string 0
    for k in range(1, len(strings)):
        s, node = strings[k], top
        while isinstance(node, tuple):  # blind descent: only the bytes at branching depths are looked at
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        depth = common(s, strings[node[0]])
        if depth == len(s):
            node.append(k)
            continue
        old, node, parent = strings[node[0]], top, None
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [k]
            continue
        branch = (depth, {old[depth]: node, s[depth]: [k]})
        if parent is None:
            top = branch
        else:
            parent[1][s[parent[0]]] = branch
    out: list[int] = []
    stack = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def multikey_quicksort(rows: list[int], strings: list[bytes]) -> list[int]:
    """rows in the order of their strings, all equally long: three-way parts by one byte after the other.

    Parts that agree in the first SHALLOW bytes are ordered by a blind trie.
    """
    shared = len({strings[r][:GRAM] for r in rows}) == 1
    out, stack = [], [(rows, GRAM if shared else 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out += part
        elif depth == SHALLOW:
            out += [part[k] for k in _blind_trie([strings[r] for r in part])]
        else:
            pivot = strings[part[len(part) // 2]][depth]
            equal = [r for r in part if strings[r][depth] == pivot]
            if len(equal) < len(part):
                more = [r for r in part if strings[r][depth] > pivot]
                less = [r for r in part if strings[r][depth] < pivot]
                stack += [(x, d) for x, d in ((more, depth), (equal, depth + 1), (less, depth)) if x]
            else:
                stack.append((equal, depth + 1))
    return out


def deep_shallow_order(group: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of suffixes by group, then by their bytes `right` (rows, zeros behind), then by `size`."""
    order = np.argsort(group, kind="stable")
    first = np.append(True, group[order][1:] != group[order][:-1]) if len(group) else np.zeros(0, bool)
    edges = np.append(np.flatnonzero(first), len(group)).tolist()
    whole = np.column_stack([right, size.astype(np.uint8)])
    width, flat = whole.shape[1], whole.tobytes()
    strings = [flat[k : k + width] for k in range(0, len(flat), width)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            order[a:b] = multikey_quicksort(order[a:b].tolist(), strings)
    return order


def repeats_in(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the smallest and largest offset at which a repeated stretch holds it; -1: none.

    left: bytes before the anchor, nearest first; right: from the anchor on; both padded with zeros.
    """
    order = deep_shallow_order(group, right, n_right)
    group, left, right, n_left, n_right = group[order], left[order], right[order], n_left[order], n_right[order]
    n = len(group)
    agree = np.zeros(n, np.int64)  # common prefix with the suffix before
    if n > 1:
        differ = right[1:] != right[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        agree[1:] = np.where(group[1:] == group[:-1], np.minimum(lcp, np.minimum(n_right[1:], n_right[:-1])), 0)
    low, high = np.full(n, -1), np.full(n, -1)
    before = np.zeros(n, np.uint64)
    for o in range(length - GRAM + 1):
        if o:
            before = blocks.mix(before * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1] + np.uint64(o))
        able = np.flatnonzero((n_right >= length - o) & (n_left >= o))
        run = np.cumsum(agree < length - o)
        key = blocks.mix(before[able] ^ run[able].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(able), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found = able[by[hit]]
        low[found] = np.where(low[found] < 0, o, low[found])
        high[found] = o
    out = np.full(n, -1), np.full(n, -1)
    out[0][order], out[1][order] = low, high
    return out


_PLACES = "array<struct<key:bigint,at:bigint>>"


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """(gram, around, key, at, more): anchors of all texts; at packs place, bytes to the left and right.

    Anchors of a slice with equal surroundings are one row, the others of them listed in `more` (else
    null), so that a line repeated very often is combined before the shuffle.
    """
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for i, j in blocks.slices(offsets):
                row, place, left, right, gram, around = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                at, key = place * 65536 + left * 256 + right, keys[i + row]
                order = np.lexsort((at, key, around[:, 1], around[:, 0], gram))
                new = np.ones(len(order), bool)
                new[1:] = (gram[order][1:] != gram[order][:-1]) | (around[order][1:] != around[order][:-1]).any(axis=1)
                first, rest = order[new], order[~new]
                n = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
                ends = np.append(0, np.cumsum(n))
                others = pa.StructArray.from_arrays([pa.array(key[rest]), pa.array(at[rest])], ["key", "at"])
                digests = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.arange(len(first) + 1, dtype=np.int32) * 16), pa.py_buffer(np.ascontiguousarray(around[first]))])
                more = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), others, mask=pa.array(n == 0)).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), digests, pa.array(key[first]), pa.array(at[first]), more], ["gram", "around", "key", "at", "more"])

    return texts.mapInArrow(read, f"gram long, around binary, key long, at long, more {_PLACES}")


def _surroundings(rows: DataFrame, length: int) -> DataFrame:
    """(gram, key, at, bytes) from (key, text, wanted array of (gram, at))."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            gram, packed = wanted.flatten().flatten()
            at = packed.to_numpy()
            data, offsets = blocks.text_bytes(batch.column("text"))
            place = offsets[row] + (at >> 16)
            start, stop = place - ((at >> 8) & 255), place + (at & 255)
            for a in range(0, len(at), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                cut = [data[x:y].tobytes() for x, y in zip(start[part].tolist(), stop[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([gram[part], batch.column("key").take(pa.array(row[part])), packed[part], pa.array(cut, pa.binary())], ["gram", "key", "at", "bytes"])

    return rows.mapInArrow(read, "gram long, key long, at long, bytes binary")


def _stretches(t: pa.Table, length: int) -> pa.RecordBatch:
    """(key, start, stop, hash) of every stretch of `length` bytes through the anchors of t."""
    data, offsets, place, n_left, n_right = _unpacked(t)
    low, high = np.maximum(0, length - n_right), np.minimum(n_left, length - GRAM)
    each = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(each)), each)
    o = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    begin = (offsets[:-1] + n_left)[row] - o
    h = blocks.span_hash(blocks.prefix_hash(data), begin, begin + length)
    start = place[row] - o
    return pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(row)), pa.array(start), pa.array(start + length), pa.array(h.view(np.int64))], ["key", "start", "stop", "hash"])


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    at = t.column("at").to_numpy()
    raw = t.column("bytes").combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.append(np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.uint8(0))
    return data, offsets - offsets[0], at >> 16, (at >> 8) & 255, at & 255


def _settled(t: pa.Table, length: int) -> pa.RecordBatch:
    """(key, start, stop, null) of what sorting the anchors of t finds repeated; t holds whole groups."""
    data, offsets, place, n_left, n_right = _unpacked(t)
    middle, n_left, n_right = (x.astype(np.int32) for x in (offsets[:-1] + n_left, n_left, n_right))
    step = np.arange(length, dtype=np.int32)
    right = np.where(step < n_right[:, None], data[np.minimum(middle[:, None] + step, len(data) - 1)], 0).astype(np.uint8)
    step = step[: length - GRAM]
    left = np.where(step < n_left[:, None], data[np.maximum(middle[:, None] - 1 - step, 0)], 0).astype(np.uint8)
    low, high = repeats_in(t.column("gram").to_numpy(), left, right, n_left, n_right, length)
    some = np.flatnonzero(low >= 0)
    columns = [pa.array(t.column("key").to_numpy()[some]), pa.array((place - high)[some]), pa.array((place - low)[some] + length)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(some), pa.int64())], ["key", "start", "stop", "hash"])


def _sorted_repeats(rows: DataFrame, length: int) -> DataFrame:
    """(key, start, stop) of repeats among (gram, key, at, bytes), which come grouped by gram.

    A group of more than CROWD suffixes is not held: its stretches are streamed out with their hashes,
    and Spark finds which of them start at two places.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, group, n, crowded, current = [], [], 0, False, None
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            other = np.flatnonzero(gram != current)
            split = int(other[0]) if len(other) else len(gram)
            parts = [batch.slice(0, split)] if split else []
            if split < len(gram):  # the group that was open is complete
                if crowded:
                    yield from (_stretches(pa.Table.from_batches([p]), length) for p in parts)
                else:
                    whole += group + parts
                edge = np.flatnonzero(gram != gram[-1])
                last = int(edge[-1]) + 1 if len(edge) else 0
                if last > split:
                    whole.append(batch.slice(split, last - split))
                group, n, crowded, current, parts = [], 0, False, gram[-1], [batch.slice(max(last, split))]
            if not crowded:
                group += parts
                n += sum(p.num_rows for p in parts)
                crowded = n > CROWD
                parts, group = (group, []) if crowded else ([], group)
            yield from (_stretches(pa.Table.from_batches([p]), length) for p in parts)
            if sum(p.num_rows for p in whole) >= AT_ONCE:
                yield _settled(pa.Table.from_batches(whole).combine_chunks(), length)
                whole = []
        if whole or group:
            yield _settled(pa.Table.from_batches(whole + group).combine_chunks(), length)

    found = rows.mapInArrow(read, "key long, start long, stop long, hash long")
    of = Window.partitionBy(F.coalesce("hash", F.xxhash64("key", "start", "stop")))
    # a stretch comes once for each crowded anchor it holds: what counts is whether it starts at two places
    place = F.when(F.col("hash").isNotNull(), F.struct("key", "start"))
    found = found.withColumn("twice", F.min(place).over(of) != F.max(place).over(of))
    return found.where("hash IS NULL OR twice").select("key", "start", "stop")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, stop): byte spans that cover exactly the repeated bytes; spans may overlap.

    texts: key long, text, any others; one row for each key.
    """
    if not GRAM < length <= 255:
        raise ValueError(f"length must lie between {GRAM + 1} and 255")
    table = _anchor_table(texts, length).repartition("gram")
    held = F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)
    alike, same = Window.partitionBy("gram", "around"), Window.partitionBy("gram")
    table = table.withColumns({
        "n_alike": F.sum(held).over(alike), "first": F.min(F.struct("key", "at")).over(alike),
    }).withColumn("n", F.sum(held).over(same)).where("n > 1")
    places = F.concat(F.array(F.struct("key", "at")), F.coalesce("more", F.array().cast(_PLACES)))
    settled = table.where("n_alike > 1").select(F.explode(places).alias("p")).select("p.key", "p.at")
    place, left, right = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    settled = settled.select("key", (place - left).alias("start"), (place + right).alias("stop"))
    open_ = table.where(F.expr("n > n_alike AND first.key = key AND first.at = at")).groupBy("key").agg(F.collect_list(F.struct("gram", "at")).alias("wanted"))
    rows = _surroundings(texts.join(open_, "key").select(*texts.columns, "wanted"), length)
    rows = rows.repartition("gram").sortWithinPartitions("gram")
    return settled.unionByName(_sorted_repeats(rows, length))


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; with keep_text) and kept_sha256 of each row.

    Every row is a document of its own, so repeated rows are repeats of each other, and all that a stretch
    covers in them goes; rows may share a doc_id or have none. Null and empty texts have no bytes. Texts
    shorter than `length` bytes hold no repeat. Other columns are ignored.
    """
    blocks.small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("key")
    # rows that are alike in all, by their bytes, are sorted and counted once
    same = Window.partitionBy("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256))
    texts = texts.withColumns({"copies": F.count(F.lit(1)).over(same), "copy": F.row_number().over(same.orderBy("key"))})
    spans = repeated_spans(texts.where("copy = 1").select("key", "text"), length).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = batch.column("text").cast(pa.binary()), []
            for k, copies in enumerate(batch.column("copies").to_pylist()):
                data, spans = text[k].as_py(), batch.column("spans")[k].values
                gone, runs, at, kept = 0, 0, 0, []
                if copies > 1 and len(data) >= length:
                    gone, runs, at = len(data), 1, len(data)
                elif spans is not None and len(spans):
                    start, stop = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    new = np.append(True, start[1:] > stop[:-1])
                    begins, ends = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                        kept.append(data[at:a])
                        gone, runs, at = gone + b - a, runs + 1, b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), gone, runs, kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array([x[c] for x in out], kinds[c]) for c in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = texts.join(spans, "key", "left").select("doc_id", "text", "copies", "spans")
    out = joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out if keep_text else out.drop("kept")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of `without_repeats` over whole documents: strings of 200 bytes."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
