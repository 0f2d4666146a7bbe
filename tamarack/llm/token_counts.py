"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Documents are reduced to (group, length, how many) inside the tasks that encode them; all answers come
from that table, whose size depends on how many different lengths occur, not on the documents.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .storage import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of a band are summed up apart, so that no window has to hold all lengths of a group.
BAND = 4096
_FLUSH = 200_000


@cache
def encoder(vocabulary: str):
    """The tokenizer of a rank file; loaded once in a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, by: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(by string, n_tokens long, n_docs long): how many documents of a group have each encoded length.

    Whole texts are encoded; null and empty texts have length 0. A null group stays a group of its own.
    Repeated rows count each. Special tokens' strings are ordinary text. Other columns are ignored.
    """
    blocks.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary).encode_ordinary, Counter()

        def out() -> pa.RecordBatch:
            group, length, n = ([x[0] for x in seen], [x[1] for x in seen], list(seen.values()))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(group, pa.string()), pa.array(length, pa.int64()), pa.array(n, pa.int64())], [by, "n_tokens", "n_docs"])

        for batch in batches:
            for group, text in zip(batch.column(0), batch.column(1), strict=True):
                seen[group.as_py(), len(encode(text.as_py() or ""))] += 1
            if len(seen) > _FLUSH:
                yield out()
        yield out()

    parts = docs.select(F.col(by).cast("string").alias(by), "text").mapInArrow(count, f"`{by}` string, n_tokens long, n_docs long")
    return parts.groupBy(by, "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: str = "source") -> DataFrame:
    """For each group and length L of the histogram, as a context limit:

    n_docs (of just that length), docs_from (L or longer), tokens_from (their tokens), total_docs,
    total_tokens, truncated_tokens (what stays when each document is cut to L), share (documents that
    fit into L, 0 to 1). An empty histogram gives no rows.
    """
    rows = histogram.withColumns({"band": F.expr(f"n_tokens div {BAND}"), "tokens": F.col("n_tokens") * F.col("n_docs")})
    bands = rows.groupBy(by, "band").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    above = Window.partitionBy(by).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(by)
    bands = bands.select(
        F.col(by).alias("group"), F.col("band").alias("of"),
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("sum_above"),
        F.sum("docs").over(every).alias("total_docs"), F.sum("sum").over(every).alias("total_tokens"),
    )
    own = Window.partitionBy(by, "band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"docs_in": F.sum("n_docs").over(own), "sum_in": F.sum("tokens").over(own)})
    rows = rows.join(bands, rows[by].eqNullSafe(bands["group"]) & (rows["band"] == bands["of"]))
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("sum_in") + F.col("sum_above")
    return rows.select(
        by, "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_from + F.col("n_docs")) / F.col("total_docs")).alias("share"),
    )


def at_limits(sums: DataFrame, limits: list[int], by: str = "source") -> DataFrame:
    """(by, limit, docs_over, truncated_tokens) for any limits: the least length above a limit answers it."""
    limit = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    rows = sums.select("*", limit)
    over = F.col("n_tokens") > F.col("limit")
    first = F.min(F.when(over, F.struct("n_tokens", "docs_from", "tokens_from"))).alias("first")
    got = rows.groupBy(by, "limit").agg(first, F.first("total_tokens").alias("total_tokens"))
    docs = F.coalesce(F.col("first.docs_from"), F.lit(0))
    return got.select(by, "limit", docs.alias("docs_over"), (F.col("total_tokens") - F.coalesce(F.col("first.tokens_from"), F.lit(0)) + F.col("limit") * docs).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float], by: str = "source") -> DataFrame:
    """(by, quantile, n_tokens): the least length into which that share of a group's documents fits."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("quantile")
    rows = sums.select(by, "n_tokens", "share", share).where("share >= quantile")
    return rows.groupBy(by, "quantile").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Suffix sums of each source's length histogram over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    return suffix_sums(cut(length_histogram(docs)))  # texts are encoded once for the several sums
