"""Mixing sources to target weights by Pfair scheduling.

A source of weight w, of all weights W together, is a task that needs w of W slots. Its k-th block (from 0)
is released at slot floor(k W / w) and due by slot ceil((k + 1) W / w); earliest deadline first fills each slot
with a released block. On one processor that meets every deadline, so at any slot a source has had less
than one block more or less than its weight times the slots.

Weights are whole numbers and are taken as they are: after W slots every source has had exactly w blocks and
the schedule repeats. So the schedule of W slots, or of as many as the data need if that is less, places
every block of every source by arithmetic: no step walks over blocks or documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import packed, unpacked, unused

#: Default weights are shares of about so many slots, and of at least so many for each source.
SHARES, PER_SOURCE = 1000, 16
#: Columns that `mix` adds.
ADDED = ("slot", "block", "place", "release", "deadline")
#: The schedule is put together from pieces of so many slots.
PIECE = 512
BLOCK = 16
BUCKET_ROWS = 10_000


def sqrt_weights(docs: DataFrame, shares: int = SHARES) -> DataFrame:
    """(source, weight long): the square root of each source's row count as whole parts of about `shares`, one at least.

    With many sources there are PER_SOURCE times as many parts as sources, so that rounding never levels them.
    """
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).count()
    size = size.select("source", F.floor(F.sqrt("count") * 1000).alias("root"))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    size = size.withColumns({"total": F.sum("root").over(every), "parts": F.greatest(F.lit(shares).cast("long"), PER_SOURCE * F.count(F.lit(1)).over(every))})
    part = F.expr("(2 * parts * root + total) div (2 * total)")
    return size.select("source", F.greatest(F.lit(1).cast("long"), part).alias("weight"))


def schedule(weights: DataFrame, slots: int) -> DataFrame:
    """(source, k, slot): the slot of each source's k-th block, k from 0, in the first `slots` slots.

    weights: (source, weight), one row each, of positive whole numbers.
    """
    tasks = weights.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("tasks"), F.sum("weight").alias("total"))  # one entry a source
    due = """array_min(transform(s.done, (a, i) -> IF(a * total div tasks[i].weight <= t,
        named_struct('due', ((a + 1) * total + tasks[i].weight - 1) div tasks[i].weight, 'i', i), NULL))).i"""
    piece = f"""aggregate(sequence(c, least(c + {PIECE}L, {slots}L) - 1),
        named_struct('done', all.done, 'picks', CAST(array() AS ARRAY<INT>)),
        (s, t) -> element_at(transform(array({due}), p -> named_struct(
            'done', transform(s.done, (a, i) -> IF(i = p, a + 1, a)), 'picks', concat(s.picks, array(p)))), 1))"""
    picks = f"""aggregate(sequence(0L, {slots - 1}L, {PIECE}L),
        named_struct('done', transform(tasks, x -> 0L), 'picks', CAST(array() AS ARRAY<ARRAY<INT>>)),
        (all, c) -> element_at(transform(array({piece}), r -> named_struct('done', r.done, 'picks', concat(all.picks, array(r.picks)))), 1),
        all -> flatten(all.picks))"""
    rows = tasks.select("tasks", F.posexplode(F.expr(picks)).alias("slot", "pick"))
    rows = rows.select("slot", F.col("tasks")[F.col("pick")]["source"].alias("source"))
    k = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1  # `slots` rows at most
    return rows.select("source", k.cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def numbered(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with mix_source (source, null as empty) and `nth`, a row's place (from 0) within it in order of md5(doc_id).

    A source of any size is cut into buckets by that order's leading bits, and each bucket's rows are
    numbered on their own and moved up by what the buckets before it hold.
    """
    n = min(65536, max(256, docs.count() // bucket_rows))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.expr(f"cast(conv(substring(mix_key, 1, 4), 16, 10) AS BIGINT) * {n} div 65536")
    rows = docs.withColumns({"mix_source": F.coalesce("source", F.lit("")), "mix_key": key}).withColumn("mix_bucket", bucket)
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)  # n rows each
    base = rows.groupBy("mix_source", "mix_bucket").count()
    base = base.select("mix_source", "mix_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("mix_base"))
    nth = F.row_number().over(Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc_id"))
    rows = rows.withColumn("nth", nth).join(base, ["mix_source", "mix_bucket"])
    return rows.withColumn("nth", F.col("nth") - 1 + F.col("mix_base")).drop("mix_base", "mix_bucket", "mix_key")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """All columns of docs and slot, block, place, release and deadline (long).

    docs: doc_id, source, any others. weights: (source, weight), positive whole numbers, one row for each
    source of docs and more if need be; by default `sqrt_weights`. A source without a weight, a weight
    below 1 and a source with two weights are errors. Sorting by (slot, place) gives the mixed order: a
    slot is one block of `block` rows of one source. A source that has no blocks left leaves its slots
    empty. Null and empty source names are one source; rows with equal doc_id follow each other; no
    rows give no rows. An added column whose name docs has already gets an underscore before it.
    """
    columns, added = docs.columns, unused(docs, *ADDED)
    docs = packed(docs, ["doc_id", "source"])
    spark = docs.sparkSession
    weights = sqrt_weights(docs) if weights is None else weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("long").alias("weight"))
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).count()
    told = sizes.join(weights, "source", "full").collect()  # one row a source
    if any(not r.weight or r.weight < 1 for r in told) or len({r.source for r in told}) < len(told):
        raise ValueError("each source needs one weight of 1 or more")
    shared = math.gcd(*[r.weight for r in told]) if told else 1
    total = sum(r.weight for r in told) // shared
    table = spark.createDataFrame([(r.source, r.weight // shared) for r in told], "source string, weight long").coalesce(1)
    # no block is due later than this
    needed = max((-(-(-(-(r["count"] or 0) // block) * total) // (r.weight // shared)) for r in told), default=0)
    slots = schedule(table, max(1, min(total, needed))).withColumnRenamed("source", "mix_source")
    rows = numbered(docs).withColumn("block", F.expr(f"nth div {block}")).withColumn("place", F.col("nth") % block)
    rows = rows.join(table.withColumnRenamed("source", "mix_source"), "mix_source").withColumn("k", F.col("block") % F.col("weight"))
    rows = rows.join(slots, ["mix_source", "k"]).withColumn("first", F.expr(f"block div weight * {total}"))
    out = rows.withColumns({
        "slot": F.col("first") + F.col("slot"),
        "release": F.expr(f"block * {total} div weight"),
        "deadline": F.expr(f"((block + 1) * {total} + weight - 1) div weight"),
    })
    out = out.select(*docs.columns, F.struct(*ADDED).alias("_mix"))
    return unpacked(out, columns, also=[F.col("_mix")[c].alias(name) for c, name in zip(ADDED, added, strict=True)])


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """Mixed order of whole documents, sources weighted by the square root of their rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


def mix_sql(table: str, columns: str, shares: int = SHARES, block: int = BLOCK) -> str:
    """`mix` with its default weights as DuckDB SQL."""
    return f"""
WITH RECURSIVE mix_docs AS (SELECT *, coalesce(source, '') AS s FROM {table}),
r AS (SELECT s, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS root FROM mix_docs GROUP BY s),
given AS (SELECT s, greatest(1, (2 * greatest({shares}, {PER_SOURCE} * n) * root + CAST(t AS BIGINT)) // (2 * CAST(t AS BIGINT))) AS w FROM r, (SELECT sum(root) AS t, count(*) AS n FROM r) z),
shared AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS g FROM given),
q AS (SELECT s, CAST(w // g AS BIGINT) AS w FROM given, shared),
tasks AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws, CAST(sum(w) AS BIGINT) AS total FROM q),
edf(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM tasks
  UNION ALL
  SELECT t + 1, list_transform(done, lambda a, i: CASE WHEN i = p THEN a + 1 ELSE a END), p FROM (
    SELECT t, done, list_sort(list_filter(list_transform(done, lambda a, i: CASE WHEN a * total // ws[i] <= t + 1
      THEN [((a + 1) * total + ws[i] - 1) // ws[i], i] ELSE NULL END), lambda x: x IS NOT NULL))[1][2] AS p
    FROM edf, tasks WHERE t < total - 1) step),
slots AS (SELECT names[pick] AS s, ws[pick] AS w, total, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf, tasks WHERE t >= 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS nth FROM mix_docs)
SELECT {columns}, nth // {block} // w * total + slot AS slot, nth // {block} AS block, nth % {block} AS place,
  nth // {block} * total // w AS release, ((nth // {block} + 1) * total + w - 1) // w AS deadline
FROM nth JOIN slots USING (s) WHERE k = nth // {block} % w"""
