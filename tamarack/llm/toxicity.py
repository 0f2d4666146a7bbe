"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding turns homoglyphs, accented and full-width letters and digit substitutions into plain lower-case
letters and everything else into blanks. The lexicon holds whole words and word beginnings with weights
(log odds between toxic and other training documents); a word counts with its heaviest match, unless it
stands in an exception phrase (two neighbouring words that training shows to be harmless). The sum of
weights and its ratio to the text's length give the score through a logistic curve.

Everything is learned from a bounded sample of labelled training rows (`train_rows`, by hash of doc_id):
the lexicon and the exceptions from all of it, the curve from features that each fold gets from a lexicon
of the other folds. Scoring reads every document once, without a shuffle.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .storage import cut

TRAIN_ROWS = 20_000
FOLDS = 3
MIN_DOCS = 4
MIN_WEIGHT = 1.2
PREFIXES = range(3, 10)

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕкмтнвԁԛԝгьαβεικνορτυχωηγ" + "0134578@$!€",
        "aeopcyxijskmthbdqwrbabeiknoptuxwny" + "oieastbasie",
        strict=True,
    )
)


class _Fold(dict):
    """str.translate table, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.lower() in LOOKALIKES:
            out = LOOKALIKES[c.lower()]
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(LOOKALIKES.get(x, x) for x in out)
            out = out if out and out.isalnum() else (" " if not unicodedata.combining(c) else "")
        self[code] = out
        return out


_FOLDS = _Fold()


def fold(text: str | None) -> str:
    """Plain letters with single characters between words turned to blanks, one blank before and behind."""
    return f" {(text or '').translate(_FOLDS)} "


def _terms(word: str) -> list[str]:
    """Lexicon entries a word can match: ' word ' and its beginnings ' wor'."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if n < len(word))]


class Matcher:
    """An automaton over a lexicon {term: weight} with exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.exceptions = frozenset(exceptions)
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        if lexicon:
            self.automaton.make_automaton()
        self.empty = not lexicon

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word and its heaviest weight."""
        best: dict[int, float] = {}
        if not self.empty:
            for end, (size, weight) in self.automaton.iter(folded):
                start = end - size + 2
                if weight > best.get(start, 0.0):
                    best[start] = weight
        return best

    @staticmethod
    def phrases(folded: str, start: int) -> list[str]:
        """The word at start with its neighbour on either side."""
        stop = folded.index(" ", start)
        word = folded[start:stop]
        end = start
        while end > 0 and folded[end - 1] == " ":
            end -= 1
        before = folded[folded.rfind(" ", 0, end) + 1 : end]
        begin = stop
        while begin < len(folded) and folded[begin] == " ":
            begin += 1
        after = folded[begin : folded.find(" ", begin)] if begin < len(folded) else ""
        return [f"{x} {y}" for x, y in ((before, word), (word, after)) if x and y]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Logarithms of the weight in all and of the weight per hundred words, and the heaviest match."""
        folded = fold(text)
        found = self.matches(folded)
        if self.exceptions:
            found = {a: w for a, w in found.items() if self.exceptions.isdisjoint(self.phrases(folded, a))}
        total = sum(found.values())
        if not total:
            return 0.0, 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), max(found.values())


_matchers: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    if shared.id not in _matchers:
        _matchers.clear()
        _matchers[shared.id] = Matcher(*shared.value[:2])
    return _matchers[shared.id]


class _Shared:
    """A broadcast value with a name that tasks can keep a matcher under."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, toxic, part): at most train_rows labelled documents in FOLDS parts."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = some.orderBy(order, "doc_id").limit(train_rows).withColumn("part", F.pmod(order, F.lit(FOLDS)))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic", "part")  # train_rows rows


def _document_counts(rows: DataFrame, wanted) -> DataFrame:
    """(term, toxic, n): in how many documents of each label a term stands; of wanted terms, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, only = Counter(), wanted.value if wanted else None

        def out() -> pa.RecordBatch:
            keys, n = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(n, pa.int64())], ["term", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                terms = {t for w in set(fold(text).split()) for t in _terms(w)}
                seen.update((t, toxic) for t in (terms if only is None else terms & only))
            if len(seen) > 500_000:
                yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(count, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms of MIN_DOCS toxic documents or more, and of MIN_WEIGHT log odds; rows are a bounded sample."""
    spark = rows.sparkSession
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    many = _document_counts(rows.where("toxic = 1"), None).where(F.col("n") >= MIN_DOCS)
    found = {r.term: r.n for r in many.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(found))
    clean = {r.term: r.n for r in _document_counts(rows.where("toxic = 0"), wanted).collect()}
    base = math.log((sizes[1] + 1) / (sizes[0] + 1))
    weight = {t: math.log((n + 0.2) / (clean.get(t, 0) + 0.5)) - base for t, n in found.items()}
    kept = {t: w for t, w in weight.items() if w >= MIN_WEIGHT}
    # a longer beginning that a kept shorter one matches as well adds nothing unless it weighs clearly more
    out: dict[str, float] = {}
    for t in sorted(kept, key=len):
        shorter = [out[p] for n in PREFIXES if n + 1 < len(t) and (p := t[: n + 1]) in out]
        if not shorter or kept[t] > max(shorter) + 0.5:
            out[t] = kept[t]
    return out


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], least: int = 3) -> list[str]:
    """Phrases around matches that `least` harmless documents or more and no toxic ones have."""
    shared = _Shared(rows.sparkSession, (lexicon, []))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text)
                out += [(p, toxic) for p in {p for a in matcher.matches(folded) for p in matcher.phrases(folded, a)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], ["phrase", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(find, "phrase string, toxic int").groupBy("phrase")
    kept = seen.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return [r.phrase for r in kept.where(F.expr(f"clean >= {least} AND bad = 0")).collect()]


def fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a little shrinkage, by damped Newton steps: weights of the columns, then the constant."""
    scale = np.append(np.maximum(x.std(axis=0), 1e-9), 1.0)
    x = np.column_stack([x, np.ones(len(x))]) / scale
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ w**2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), slope)
        rate = 1.0
        while rate > 1e-6 and loss(w + rate * step) > loss(w):
            rate /= 2
        w = w + rate * step
        if rate * np.abs(step).max() < 1e-7:
            break
    return (w / scale).tolist()


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """{lexicon, exceptions, curve}, learned from at most train_rows labelled documents.

    Labels: (doc_id, toxic); null labels and ids are left out, of repeated ids the largest label holds.
    Repeated documents count each; other columns of either table are ignored, whatever their names.
    Without documents of both labels the lexicon is empty and the curve None: scores are then 0.
    """
    blocks.small_batches(docs.sparkSession)
    rows = cut(sample(docs, labels, train_rows))
    told = []
    for fold in range(FOLDS):
        shared = _Shared(rows.sparkSession, _learned(rows.where(F.col("part") != fold)))

        def features(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [_matcher(shared).features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[pa.array([v[k] for v in x], pa.float64()) for k in range(3)], batch.column("toxic")], ["a", "b", "c", "toxic"])

        told.append(rows.where(F.col("part") == fold).mapInArrow(features, "a double, b double, c double, toxic int").toPandas())  # train_rows / FOLDS rows
    held = pd.concat(told)
    lexicon, exceptions = _learned(rows)
    curve = fit_curve(held[["a", "b", "c"]].to_numpy(), held["toxic"].to_numpy()) if held["toxic"].nunique() > 1 and lexicon else None
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": curve}


def _learned(rows: DataFrame) -> tuple[dict[str, float], list[str]]:
    lexicon = learn_lexicon(rows)
    return lexicon, learn_exceptions(rows, lexicon) if lexicon else []


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs and `score` double, 0 to 1, of its whole text.

    Null and empty texts have no matches and get the curve's least score. A column named score is refused.
    """
    if "score" in docs.columns:
        raise ValueError("documents already have a column score")
    blocks.small_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, (model["lexicon"], model["exceptions"], model["curve"]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = shared.value[2]
        for batch in batches:
            out = []
            for text in batch.column("text"):
                z = None if curve is None else np.dot((*_matcher(shared).features(text.as_py()), 1.0), curve)
                out.append(0.0 if z is None else float(1 / (1 + math.exp(-max(-30.0, min(30.0, z))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{ddl}, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a row is for testing only: crc32 of its id, as text, is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: scores of whole documents, learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


