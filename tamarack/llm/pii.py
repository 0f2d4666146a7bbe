"""Personal data: fixed base patterns, and lexical patterns bootstrapped from what they find.

DataFrame functions only. Base patterns give e-mail addresses, IP addresses, card and phone numbers.
Their spans seed a graph between lexical patterns and instances (what stands there, in lower case). A
mention has up to two patterns, the word before it and the two words before it; how the mention itself looks
is no pattern, so numbers in running prose are never taken for cards by their length. Spark scores the graph in turns: a pattern is as good as the share of its occurrences whose instance is
trusted, an instance as good as its best pattern. Patterns that reach CONFIDENCE with enough different
instances then mark further identifier-like tokens, those the base patterns miss, as personal data of the
kind they stand for.

Spans of a text are found in chunks of about the square root of their number, so the work grows little
more than linearly with a text that consists of nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, kept

KINDS = ("email", "ip", "card", "phone")
#: What a span of each kind must look like. A look-behind, or \G for what follows an
#: earlier match, only spares the engine starts within a run that cannot succeed; possessive repetition
#: keeps long runs off its stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this holds no span of the kind.
_MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: A token that could be an identifier: six characters or more, at least three of them digits.
TOKEN = r"(?<![A-Za-z0-9@+._-])(?=(?:[A-Za-z@+._-]*+[0-9]){3})[A-Za-z0-9@+._-]{6,}+"
_MAYBE_TOKEN = r"[0-9][A-Za-z@+._-]*+[0-9][A-Za-z@+._-]*+[0-9]"
CONFIDENCE = 0.6
MIN_SEEDS = 3
TURNS = 3
#: Lexical patterns look at so many characters before a mention; words that reach beyond are no pattern.
REACH = 120
_SPAN = "array<struct<start:bigint,stop:bigint,of:string,before:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and in whatever lambdas body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str, maybe: str) -> Column:
    """Spans of all matches in code points, with what they match and up to REACH characters before them.

    Matches and the gaps before them are cut into chunks of about the square root of their number; where
    a chunk starts comes from the chunks' lengths, and places within it are summed up inside the chunk.
    """
    none = F.array().cast(_SPAN)

    def spans(pairs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.size(pairs), size), lambda i: F.slice(pairs, i, size))
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["gap"]) + F.length(x["of"])))
        tails = F.transform(chunks, lambda c: F.right(F.aggregate(F.slice(c, -REACH, REACH), F.lit(""), lambda s, x: F.right(F.concat(s, F.right(x["gap"], F.lit(REACH)), F.right(x["of"], F.lit(REACH))), F.lit(REACH))), F.lit(REACH)))
        sums = F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        heads = F.arrays_zip(chunks.alias("chunk"), F.slice(sums, F.lit(1), F.size(chunks)).alias("base"), F.concat(F.array(F.lit("")), tails).alias("tail"))
        return F.flatten(F.transform(F.filter(heads, lambda h: h["chunk"].isNotNull()), _chunk_spans))

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.when(F.size(found) == 0, none).otherwise(_bound(F.arrays_zip(gaps.alias("gap"), found.alias("of")), spans))

    return F.when(text.rlike(maybe), _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)).otherwise(none)


def _chunk_spans(head: Column) -> Column:
    start = F.struct(head["base"].alias("at"), head["tail"].alias("tail"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["of"])
        before = F.right(F.concat(s["tail"], F.right(x["gap"], F.lit(REACH))), F.lit(REACH))
        span = F.struct(begin.alias("start"), end.alias("stop"), x["of"].alias("of"), before.alias("before"))
        tail = F.right(F.concat(before, F.right(x["of"], F.lit(REACH))), F.lit(REACH))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.aggregate(head["chunk"], start, step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right doubled, digit sums added up."""

    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, of: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(of, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return _luhn(_digits(of))
    if kind == "phone":
        return F.length(_digits(of)).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["of"])


def _of_kind(kind: str, span: Column) -> Column:
    return span.withField("kind", F.lit(kind))


def _ranked(kind: str, span: Column) -> Column:
    return F.struct(span["start"], F.lit(KINDS.index(kind)).alias("rank"), span["stop"], F.lit(kind).alias("kind"))


def _words_before(before: Column, n: int) -> Column:
    """The last n words before a span, digits folded; null where they are not all within reach."""
    words = F.regexp_extract(F.lower(before), rf"\s((?:[^\s]++\s+){{{n - 1}}}[^\s]+?)\s*[:=(\"']*\s*$", 1)
    start = F.regexp_extract(F.lower(before), rf"^((?:[^\s]++\s+){{{n - 1}}}[^\s]+?)\s*[:=(\"']*\s*$", 1)
    whole = F.when(words != "", words).when(F.length(before) < REACH, start).otherwise(F.lit(""))
    return F.nullif(F.regexp_replace(F.regexp_replace(whole, "[0-9]", "0"), r"\s+", " "), F.lit(""))


def patterns(before: Column) -> Column:
    """The lexical patterns of a mention: two words before it, one word before it."""
    made = F.array(*[F.concat(F.lit(f"{n} "), _words_before(before, n)) for n in (2, 1)])
    return F.filter(made, lambda p: p.isNotNull())


def base_spans(docs: DataFrame) -> DataFrame:
    """docs and an array of valid spans of each kind, column by kind; null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({k: _located(text, PATTERNS[k], _MAYBE[k]) for k in KINDS})
    return rows.withColumns({k: F.filter(k, partial(_valid_span, k)) for k in KINDS})


def _covered(spans: Column, token: Column) -> Column:
    """Whether one of spans (ascending, apart from each other) overlaps token, by binary search."""
    step = lambda at, stride: F.when(F.get(spans, at + stride - 1)["start"] < token["stop"], at + stride).otherwise(at)
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), F.lit(0), step)
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, at - 1)["stop"] > token["start"], F.lit(False))


def mentions(rows: DataFrame) -> DataFrame:
    """(key, doc_id, base, told): spans and mentions of each row, cut off from the texts they come from.

    A mention is (kind, patterns, instance, start, stop), kind null for tokens that no base span overlaps.
    """
    spans = rows.withColumn("tokens", _located(F.coalesce("text", F.lit("")), TOKEN, _MAYBE_TOKEN))
    apart = F.filter("tokens", lambda t: ~(_covered(F.col("email"), t) | _covered(F.col("ip"), t) | _covered(F.col("card"), t) | _covered(F.col("phone"), t)))
    spans = spans.withColumn("free", F.when(F.size("tokens") > 0, apart).otherwise(F.col("tokens")))
    base = F.concat(*[F.transform(k, partial(_ranked, k)) for k in KINDS])
    both = F.concat(*[F.transform(k, partial(_of_kind, k)) for k in KINDS], F.transform("free", lambda t: t.withField("kind", F.lit(None).cast("string"))))
    told = F.transform(both, lambda m: F.struct(m["kind"].alias("kind"), patterns(m["before"]).alias("patterns"), F.lower(m["of"]).alias("instance"), m["start"].alias("start"), m["stop"].alias("stop")))
    return cut(spans.select("key", "doc_id", base.alias("base"), told.alias("told")))


def pattern_edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n) of mentions (kind, patterns, instance): how often they stand together."""
    return found.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))


def trusted_patterns(edges: DataFrame, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS, turns: int = TURNS) -> DataFrame:
    """(pattern, kind, score) of patterns that `turns` rounds over the pattern-instance graph leave trusted.

    Seeds have score 1 for their kind; any other instance takes its best pattern's score of the turn
    before. A pattern scores, for a kind, the sum of its occurrences' scores over all its occurrences,
    once it has `min_seeds` different instances with a score, seeds or discovered ones.
    """
    edges = cut(edges)
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.where("kind IS NOT NULL").select("pattern", "instance", "kind", "n", F.lit(1.0).alias("trust"))
    free, trusted = edges.where("kind IS NULL").select("pattern", "instance", "n"), seeds
    for turn in range(turns):
        if turn:
            good = current.where(F.col("score") >= confidence)
            instance = free.join(good, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("trust"))
            trusted = seeds.unionByName(free.join(instance, "instance").select(seeds.columns))
        support = trusted.groupBy("pattern", "kind", "instance").agg(F.sum(F.col("n") * F.col("trust")).alias("gain"))
        support = support.groupBy("pattern", "kind").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("seeds"))
        support = support.where(F.col("seeds") >= min_seeds).join(total, "pattern")
        current = cut(support.select("pattern", "kind", (F.col("gain") / F.col("total")).alias("score")))
    best = current.where(F.col("score") >= confidence).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b"))
    return kept(best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")))  # its size decides how mentions, of which one pattern may have very many, are joined


def discovered(found: DataFrame, good: DataFrame) -> DataFrame:
    """(key, start, stop, kind): mentions without a kind, of the kind of their best trusted pattern."""
    free = found.where("kind IS NULL").select("key", "start", "stop", F.explode("patterns").alias("pattern"))
    return free.join(good, "pattern").groupBy("key", "start", "stop").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))


def find_pii(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base and spans: arrays of (start, stop, kind) in code points, by start, then in the kinds' order.

    spans also has what trusted patterns mark, of kind `context_` and the kind they stand for. One row
    per row of docs (doc_id, text), with or without doc_id; null and empty texts have none; repeated rows
    count once as evidence and are told alike; other columns are ignored. Texts are read once: what
    follows works on the spans found.
    """
    rows = base_spans(docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text"))
    found = mentions(rows)
    seen = found.where("size(told) > 0").select("key", F.explode("told").alias("m")).select("key", "m.*").distinct()
    marked = discovered(seen, trusted_patterns(pattern_edges(seen), confidence))
    extra = marked.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "stop", F.concat(F.lit("context_"), "kind").alias("kind"))).alias("extra"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    return found.join(extra, "key", "left").select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def held_out_seeds(docs: DataFrame, parts: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, hidden, found, wrong): how well patterns find seeds that they were not shown, and what else they mark.

    Of the base instances one in `parts`, by hash, takes part as an ordinary token. hidden: their mentions;
    found: those marked with their own kind; wrong: those marked with another one. Kind `none` has all ordinary
    tokens: found are those that stay unmarked, wrong those that are marked.
    """
    seen = mentions(base_spans(docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")))
    seen = seen.select("key", F.explode("told").alias("m")).select("key", "m.*").distinct()
    hide = F.pmod(F.xxhash64("instance"), F.lit(parts)) == 0
    shown = seen.withColumn("truth", F.when(hide, F.col("kind"))).withColumn("kind", F.when(~hide, F.col("kind")))
    marked = discovered(shown, trusted_patterns(pattern_edges(shown), confidence)).withColumnRenamed("kind", "told")
    out = shown.where("truth IS NOT NULL OR kind IS NULL").join(marked, ["key", "start", "stop"], "left").groupBy(F.coalesce("truth", F.lit("none")).alias("kind"))
    return out.agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.expr("told <=> truth")).alias("found"), F.count_if(F.expr("told IS NOT NULL AND NOT (told <=> truth)")).alias("wrong"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of `find_pii` over whole documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
