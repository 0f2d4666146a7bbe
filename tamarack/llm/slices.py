"""Questions that slices of a corpus ask about their windows of words, answered by shards of the hash range.

A slice is some MB of whole texts. For a level it names each of its distinct windows once, by hash, with a
value (a count, or a least id), and sends them as packed bytes to the shards that own those hashes. A shard
reduces the values of equal hashes over all slices and answers with one bit for each name it was sent, in
the same order. So a window costs a few bytes of shuffle whatever its length, one that is very frequent is
sent once by each slice only, and texts never move: slices lie in a bucketed table and answers, which are
small, are joined to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .storage import Stash, remove, shared_folder

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Windows that a shard is meant to answer for.
SHARD_WINDOWS = 16 << 20
_ANSWERS = "array<struct<shard:int,bits:binary>>"
#: Fixed odd multiplier of the windows' polynomial.
_BASE = 0xD1342543DE82EF95


def window_hashes(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` words from each of places on; equal words in equal order have equal hashes."""
    h = np.zeros(len(places), np.uint64)
    for j in range(length):
        h += words[places + j] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    return blocks.mix(h)


class Named:
    """The distinct hashes of a slice's windows, ascending: `of` gives each window's place among them."""

    def __init__(self, hashes: np.ndarray, shards: int):
        self.order = np.argsort(hashes)
        ranked = hashes[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.first = np.flatnonzero(new)
        self.hashes = ranked[self.first]
        self.of = np.empty(len(ranked), np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.shard = ((self.hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def reduced(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        """ufunc over the values of each hash's windows."""
        return ufunc.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each window the bit that its hash was answered with."""
        edges = np.append(np.flatnonzero(np.diff(self.shard, prepend=-1)), len(self.shard))
        bits = [np.unpackbits(np.frombuffer(answers[int(self.shard[a])], np.uint8), count=b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[self.of]


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """The least value and the others' distances from it, in as many bytes as the largest needs."""
    base = int(values.min())
    above = (values - base).astype(np.uint64)
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(above.max()) < 1 << 8 * np.dtype(k).itemsize)
    return base, above.astype(kind).tobytes()


def _wide(base: int, packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) + base


class Slices:
    """Slices of texts in the shared folder, for the time of a `with` block.

    columns: those kept beside text, each as an array per slice.
    """

    def __init__(self, texts: DataFrame, columns: list[str], windows_per_byte: float = 0.2, slice_bytes: int = SLICE_BYTES, shards: int | None = None):
        self.texts, self.columns, self.spark, self.bytes = texts, columns, texts.sparkSession, slice_bytes
        self.name = f"slices_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self.shards, self.per_byte = shards, windows_per_byte

    def __enter__(self) -> Slices:
        blocks.small_batches(self.spark)
        self.stash = Stash(self.spark).__enter__()
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        kinds = {c: self.texts.schema[c].dataType.simpleString() for c in self.columns}
        schema = ", ".join(["slice long", "n_bytes long", *(f"`{c}` array<{k}>" for c, k in kinds.items()), "text array<string>"])
        rows = self.texts.select(*self.columns, "text").mapInArrow(_sliced(self.columns, self.bytes), schema)
        rows.write.bucketBy(self.parts, "slice").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        if self.shards is None:
            total = self.table.agg(F.sum("n_bytes")).first()[0] or 0
            self.shards = max(2 * self.parts, int(total * self.per_byte) // SHARD_WINDOWS)
        return self

    def __exit__(self, *_) -> None:
        self.stash.__exit__()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def joined(self, answers: DataFrame | None) -> DataFrame:
        """The slices, each with (answers, state) of the level before; null at the first."""
        if answers is None:
            return self.table.withColumns({"answers": F.lit(None).cast(_ANSWERS), "state": F.lit(None).cast("binary")})
        return self.table.join(answers.drop("survivors"), "slice")

    def asked(self, answers: DataFrame | None, step: Callable, reduce: Callable, width: int = 4) -> DataFrame:
        """(slice, answers, state, survivors) of a level, stored.

        step(columns, answers, state, shards) gives (Named, values of its hashes, state bytes); reduce(hashes,
        values) gives the bit of each. Hashes are sent in `width` bytes besides the shard's own bits: with 4,
        a few windows may be taken for others, so such a level only says which windows may go on.
        """
        shards, columns = self.shards, self.columns

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    named, values, state = step(*_taken(batch, k, columns), shards)
                    key, edges = batch.column("slice")[k].as_py(), np.append(np.flatnonzero(np.diff(named.shard, prepend=-1)), len(named.shard))
                    sent = named.hashes.astype(f"<u{width}")
                    rows = [(int(named.shard[a]), sent[a:b].tobytes(), *_narrow(values[a:b]), None) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    rows.append((key % shards, None, None, None, state))
                    shard, hashes, base, packed, states = zip(*rows, strict=True)
                    arrays = [pa.array([key] * len(rows), pa.int64()), pa.array(shard, pa.int32()), pa.array(hashes, pa.binary()), pa.array(base, pa.int64()), pa.array(packed, pa.binary()), pa.array(states, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["slice", "shard", "hashes", "base", "packed", "state"])

        def answer(asked: pa.Table) -> pa.Table:
            told = asked.filter(asked.column("hashes").is_valid())
            hashes = [np.frombuffer(x.as_py(), f"<u{width}") for x in told.column("hashes")]
            values = [_wide(base.as_py(), x.as_py(), len(h)) for base, x, h in zip(told.column("base"), told.column("packed"), hashes, strict=True)]
            bits, out, n, at = reduce(np.concatenate(hashes), np.concatenate(values)) if hashes else [], [], [], 0
            for h in hashes:
                own = bits[at : at + len(h)]
                out.append(np.packbits(own).tobytes())
                n.append(int(own.sum()))
                at += len(h)
            kept = asked.filter(asked.column("hashes").is_null())
            names = ["slice", "shard", "bits", "n", "state"]
            first = pa.Table.from_arrays([told.column("slice"), told.column("shard"), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.nulls(len(out), pa.binary())], names)
            rest = pa.Table.from_arrays([kept.column("slice"), kept.column("shard"), pa.nulls(len(kept), pa.binary()), pa.nulls(len(kept), pa.int64()), kept.column("state")], names)
            return pa.concat_tables([first, rest])

        asks = self.joined(answers).mapInArrow(ask, "slice long, shard int, hashes binary, base long, packed binary, state binary")
        told = asks.groupBy("shard").applyInArrow(answer, "slice long, shard int, bits binary, n long, state binary")
        bits = F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("shard", "bits")))
        return self.stash.keep(told.groupBy("slice").agg(bits.alias("answers"), F.max("state").alias("state"), F.coalesce(F.sum("n"), F.lit(0)).alias("survivors")))

    def applied(self, answers: DataFrame | None, step: Callable, schema: str) -> DataFrame:
        """Rows that step(columns, answers, state, shards) yields as record batches for each slice."""
        shards, columns = self.shards, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from step(*_taken(batch, k, columns), shards)

        return self.joined(answers).mapInArrow(run, schema)


def _taken(batch: pa.RecordBatch, k: int, columns: list[str]) -> tuple[dict[str, pa.Array], dict[int, bytes], bytes | None]:
    """Row k of joined slices: its columns, its answers by shard, its state."""
    answers = batch.column("answers")[k].as_py()
    return {c: batch.column(c)[k].values for c in [*columns, "text"]}, {x["shard"]: x["bits"] for x in answers or ()}, batch.column("state")[k].as_py()


def _sliced(columns: list[str], size: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = TaskContext.get().partitionId() << 32, 0
        held, held_bytes = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, t.num_rows], pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in t.columns]
            return pa.RecordBatch.from_arrays([pa.array([own + k], pa.int64()), pa.array([held_bytes], pa.int64()), *arrays], ["slice", "n_bytes", *columns, "text"])

        for batch in batches:
            offsets = blocks.text_bytes(batch.column("text"))[1]
            for i, j in blocks.slices(offsets, size):
                n = int(offsets[j] - offsets[i])
                if held and held_bytes + n > size:
                    yield out()
                    held, held_bytes, k = [], 0, k + 1
                held.append(batch.slice(i, j - i))
                held_bytes += n
        if held:
            yield out()

    return read


def at_least(threshold: int) -> Callable:
    """A reduction: whether the values of equal hashes sum up to threshold."""

    def reduce(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
        named = Named(hashes.astype(np.uint64), 1)
        return (named.reduced(np.add, values) >= threshold)[named.of]

    return reduce


def smaller_elsewhere(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A reduction: whether another value of an equal hash is smaller than the own one."""
    named = Named(hashes.astype(np.uint64), 1)
    return named.reduced(np.minimum, values)[named.of] < values


def survivors(answers: DataFrame) -> int:
    """How many names were answered with yes."""
    return answers.agg(F.sum("survivors")).first()[0] or 0
