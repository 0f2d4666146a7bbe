"""Collocations by prefix-free parsing.

Texts are parsed into chunks that begin and end at triggers: runs of `longest - 1` words whose hash says
so, wherever they stand. Neighbouring chunks share the trigger between them, so every phrase of up to
`longest` words lies in the chunk that holds its first word, and the shared words are assigned once: to the
chunk that begins with them. Repeated text gives equal chunks, and the parse is a dictionary of distinct
chunks with their frequencies; phrases are counted inside the dictionary, each occurrence with its chunk's
frequency.

Which phrases can be frequent enough is asked level by level (a phrase only if its beginning and its rest
are) with `slices`; the frequent ones are then counted as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .slices import Named, Slices, at_least, survivors, window_hashes
from .storage import Stash, cut

LONGEST = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer one holds it that is this frequent, in percent of its own frequency.
ABSORBED = 80
#: One in so many runs of words is a trigger.
SPACING = 16
#: A first ranking in so many parts keeps the last one small.
PARTS = 32
_BREAKS = bytes(b".,;:!?\n\x0b\x0c\r")
_WORD = blocks.word_class(_BREAKS + b" \t")
_BREAK = ~blocks.word_class(_BREAKS)
_CHUNK_WORD = blocks.word_class(b" ")


def _triggers(words: np.ndarray, width: int, spacing: int) -> np.ndarray:
    """For each word whether a trigger of `width` words would begin there, whatever text it stands in."""
    out = np.zeros(len(words), bool)
    if len(words) >= width:
        places = np.arange(len(words) - width + 1)
        out[places] = window_hashes(words, places, width) % np.uint64(spacing) == 0
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.LargeStringArray:
    """Strings of `size` bytes from each start; they may overlap."""
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    raw = data[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(raw))


def parsed(docs: DataFrame, longest: int = LONGEST, spacing: int = SPACING) -> DataFrame:
    """(lang, chunk): all chunks of the parse, their words in lower case with one blank between."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column("text"))
            lang = batch.column("lang").fill_null("und")
            for i, j in blocks.slices(offsets):
                own, at = blocks.fold_case(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                starts, ends, first = blocks.word_places(own, at, _WORD)
                n = len(starts)
                if not n:
                    continue
                breaks = np.append(0, np.cumsum(_BREAK[own]))
                opens = np.ones(n, bool)
                opens[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
                opens[first[:-1][first[:-1] < n]] = True
                piece = np.flatnonzero(opens)
                stop = np.append(piece[1:], n)[np.cumsum(opens) - 1]
                trigger = _triggers(blocks.byte_hash(own, starts, ends), longest - 1, spacing) & ~opens & (np.arange(n) + longest - 1 <= stop)
                begin = np.flatnonzero(opens | trigger)
                after = np.append(begin[1:], n)
                last = np.where(np.append(trigger, False)[after], after + longest - 1, after)
                # the words on end with one blank behind each
                size = ends - starts + 1
                place = np.append(0, np.cumsum(size))
                plain = np.append(own, np.uint8(32))[np.repeat(starts - place[:-1], size) + np.arange(place[-1])]
                plain[place[1:] - 1] = 32
                doc = np.searchsorted(first, begin, side="right") - 1
                chunks = _gathered(plain, place[begin], place[last] - 1 - place[begin])
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc + i)), chunks.cast(pa.string())], ["lang", "chunk"])

    return docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(read, "lang string, chunk string")


def dictionary(docs: DataFrame, longest: int = LONGEST, spacing: int = SPACING) -> DataFrame:
    """(lang, text, freq): the distinct chunks of each lang's parse and how often they occur."""
    return parsed(docs, longest, spacing).groupBy("lang", F.col("chunk").alias("text")).agg(F.count(F.lit(1)).alias("freq"))


class _Chunks:
    """Words of a slice of the dictionary: hashes that differ by lang, weights, and which begin phrases here."""

    def __init__(self, columns: dict[str, pa.Array], longest: int, spacing: int):
        self.data, offsets = blocks.text_bytes(columns["text"])
        self.starts, self.ends, at = blocks.word_places(self.data, offsets, _CHUNK_WORD)
        size = np.diff(at)
        self.chunk, self.stop = np.repeat(np.arange(len(size)), size), np.repeat(at[1:], size)
        words = blocks.byte_hash(self.data, self.starts, self.ends)
        # a chunk that ends with a trigger shares it with the next one
        trigger = _triggers(words, longest - 1, spacing)
        shared = (size >= longest) & trigger[np.maximum(at[1:] - longest + 1, 0)]
        self.own = np.arange(len(words)) < self.stop - np.repeat(np.where(shared, longest - 1, 0), size)
        langs = columns["lang"].dictionary_encode()
        told, names = blocks.text_bytes(langs.dictionary)
        of_lang = blocks.byte_hash(told, names[:-1], names[1:])[langs.indices.to_numpy()]
        self.hashes = blocks.mix(words + blocks.mix(of_lang)[self.chunk])  # a word that is another lang's name stays apart
        self.weight = columns["freq"].to_numpy()[self.chunk] * self.own

    def whole(self, length: int) -> np.ndarray:
        return np.flatnonzero(np.arange(len(self.chunk)) + length <= self.stop)


def _planes(places: list[np.ndarray], n: int) -> bytes:
    bits = np.zeros((len(places), n), bool)
    for k, p in enumerate(places):
        bits[k, p] = True
    return np.packbits(bits, axis=1).tobytes()


def _lived(words: _Chunks, answers: dict[int, bytes], state: bytes, shards: int) -> list[np.ndarray]:
    """Places of the phrases that are frequent enough, for each length asked so far from 2 on."""
    n = len(words.chunk)
    rows = np.frombuffer(state, np.uint8).reshape(-1, -(-n // 8)) if n else np.zeros((0, 0), np.uint8)
    places = [np.flatnonzero(np.unpackbits(x, count=n)) for x in rows]
    if places:
        places[-1] = places[-1][Named(window_hashes(words.hashes, places[-1], len(places) + 1), shards).answered(answers)]
    return places


def _level(length: int, longest: int, spacing: int):
    def step(columns, answers, state, shards):
        words = _Chunks(columns, longest, spacing)
        lived = _lived(words, answers, state, shards) if state is not None else []
        places = words.whole(length)
        if lived:
            alive = np.zeros(len(words.chunk) + 1, bool)
            alive[lived[-1]] = True
            places = places[alive[places] & alive[places + 1]]
        named = Named(window_hashes(words.hashes, places, length), shards)
        return named, named.reduced(np.add, words.weight[places]), _planes([*lived, places], len(words.chunk))

    return step


def _frequent(longest: int, spacing: int):
    """(lang, n_words, phrase, a) of a slice: its words, phrases that may be frequent, and (n_words 0) all words in all."""

    def step(columns, answers, state, shards) -> Iterator[pa.RecordBatch]:
        words = _Chunks(columns, longest, spacing)
        langs = columns["lang"]
        for length, places in enumerate([words.whole(1), *_lived(words, answers, state, shards)], 1):
            places = places[words.own[places]]
            named = Named(window_hashes(words.hashes, places, length), 1)
            at = places[named.order[named.first]]
            phrases = _gathered(words.data, words.starts[at], words.ends[at + length - 1] - words.starts[at])
            n, lang = pa.array(np.full(len(at), length), pa.int32()), langs.take(pa.array(words.chunk[at]))
            yield pa.RecordBatch.from_arrays([lang, n, phrases.cast(pa.string()), pa.array(named.reduced(np.add, words.weight[places]))], ["lang", "n_words", "phrase", "a"])
        each = langs.dictionary_encode()
        code = each.indices.to_numpy()[words.chunk]
        total = np.zeros(len(each.dictionary), np.int64)
        np.add.at(total, code, words.weight)
        yield pa.RecordBatch.from_arrays([each.dictionary, pa.array(np.zeros(len(total)), pa.int32()), pa.array([""] * len(total)), pa.array(total)], ["lang", "n_words", "phrase", "a"])

    return step


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, spacing: int = SPACING, **sizes) -> DataFrame:
    """(lang, n_words int, phrase, a): phrases of 1 to longest words with at least `least` occurrences; n_words 0: all words."""
    with Slices(dictionary(docs, longest, spacing), ["lang", "freq"], **sizes) as slices:
        answers = None
        for length in range(2, longest + 1):
            answers = slices.asked(answers, _level(length, longest, spacing), at_least(least))
            if not survivors(answers):
                break
        rows = slices.applied(answers, _frequent(longest, spacing), "lang string, n_words int, phrase string, a long")
        return cut(rows.groupBy("lang", "n_words", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("n_words") == 0)))


def _first_words(phrase: str, k: str) -> str:
    return f"substring_index({phrase}, ' ', {k})"


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score): the candidates of `frequent_phrases` with their lowest-scoring cut."""
    cuts = counts.where("n_words > 1").withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)")))
    cuts = cuts.selectExpr("*", f"{_first_words('phrase', 'k')} AS head", f"{_first_words('phrase', 'k - n_words')} AS rest")
    part = counts.where("n_words > 0")
    cuts = cuts.join(part.selectExpr("lang", "phrase AS head", "a AS l"), ["lang", "head"]).join(part.selectExpr("lang", "phrase AS rest", "a AS r"), ["lang", "rest"])
    exact = "CAST(2000000 AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"
    best = cuts.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def _absorbed(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates that a longer candidate holds and (percent) is frequent enough to stand for."""
    longer = counts.where("n_words > 2").selectExpr("lang", "n_words", "a", "split(phrase, ' ') AS w")
    longer = longer.select("lang", "a", "n_words", "w", F.explode(F.expr("sequence(2, n_words - 1)")).alias("size"))
    inner = longer.select("lang", "a", F.explode(F.expr("transform(sequence(1, n_words - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = "CAST({} AS DECIMAL(19, 0)) * {}"
    return counts.where("n_words > 1").join(most, ["lang", "phrase"]).where(f"{wide.format('longer', 100)} >= {wide.format('a', percent)}").select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases of 2 to longest words.

    docs: lang, text; other columns are ignored. Null and empty texts have no words; a null lang is `und`,
    together with rows that say so. Repeated rows each count. Ranked by score, then a, both descending, then
    by the phrase's bytes. Inside a slice equal phrases are found by 64-bit hashes of their words; over all
    slices they are counted as text.
    """
    with Stash(docs.sparkSession) as stash:
        counts = stash.keep(frequent_phrases(docs, longest, least, **sizes))
        kept = scored(counts).join(_absorbed(counts, absorbed), ["lang", "phrase"], "left_anti")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        total = counts.where("n_words = 0").selectExpr("lang", "a AS n")
        return cut(first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each lang over whole documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
