"""SpotSigs fingerprints, with DataFrame functions only.

Common words (anchors) mark spots in running text; each run of anchors with the CHAIN content words that
follow it is a signature. Anchors are rare in menus, tables and numbers, so signatures come from prose.
A document is its set of signatures; sets are compared by Jaccard, pruned by length: a smaller set
cannot be more alike than the ratio of the sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

CHAIN = 3
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i in is it its not of on or she so that "
    "the their there they this to was we were which will with would you "
    "aber als am auch auf aus bei bin das dem den der des die du ein eine einem einen einer er es für hat ich im ist "
    "mit nach nicht noch nur oder sich sie sind so über um und uns vom von war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas "
    "plus pour qui que sa se ses son sont sur tout un une vous "
    "al como con del e el ella era esta este fue ha hay la las lo los más me mi muy no nos o para pero por se si sin "
    "su sus un una y ya"
)
_MARK = "\u0001"
_GROUP_ROWS = 500


def _tokens(text: Column, anchors: str) -> Column:
    """Content words in order; one that follows anchors has the last of them and a mark before it."""
    words = "|".join(sorted(set(anchors.split())))
    low = F.lower(F.coalesce(text, F.lit("")))
    spots = F.regexp_replace(low, rf"(?<![\p{{L}}\p{{N}}])(?:({words})(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*+)++", f"$1{_MARK}")
    return F.filter(F.split(spots, rf"[^\p{{L}}\p{{N}}{_MARK}]+"), lambda t: (t != "") & ~t.endswith(_MARK))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and in whatever lambdas body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, anchors: str = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (32 bits each) of a text.

    A text with words but without a spot has one signature, of all its words; a null text or one
    without words has none.
    """

    def chained(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            rest = [F.substring_index(F.get(tokens, i + k), _MARK, -1) for k in range(1, chain)]
            return F.when(t.contains(_MARK), F.shiftrightunsigned(F.xxhash64(t, *rest), 32))

        found = F.array_sort(F.array_distinct(F.filter(F.transform(tokens, one), lambda x: x.isNotNull())))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(tokens, " ")), 32))
        return _bound(found, lambda s: F.when((F.size(s) > 0) | (F.size(tokens) == 0), s).otherwise(whole))

    return _bound(_tokens(text, anchors), chained)


def as_string(signed: Column) -> Column:
    """A set as one string: eight hexadecimal digits a signature, ascending."""
    return F.array_join(F.transform(signed, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 1 for two empty ones. 0 where sizes alone rule `least` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * least), F.lit(0.0)).otherwise(exact)


def similar_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct signature sets alike by `least` or more, named by the least doc_id that has each; a < b.

    Sets are partitioned by length with bounds that grow by 1 / least, so a set meets only sets of its own
    partition and of the next. In each it is listed under the first size - ceil(least * size) + 1 of its
    signatures, one of which two alike sets share; pairs of a list go on when their sizes allow the
    likeness and what follows the shared signature in both can still reach it. Documents with equal
    signatures are one set; sets without signatures and rows without doc_id are left out.
    """
    signed = docs.where("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("sigs"))
    sets = cut(signed.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs"))).where("n > 0")
    band = F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9)
    front = F.slice("sigs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    listed = sets.select("doc_id", "n", band.alias("band"), F.posexplode(front).alias("i", "sig"))
    other = listed.select(F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), "sig", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    need = least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9
    reach = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    met = listed.join(other, ["band", "sig"]).where((F.col("doc_id") != F.col("other")) & (F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9) & (reach >= need))
    pairs = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("sigs").alias(f"sigs_{k}")) for k in "ab")
    alike = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b"), least))
    return alike.where(F.col("likeness") >= least).select("a", "b", "likeness")


def _group_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value, by binary search; -1 for null."""
    array = F.array(*[F.lit(int(b)).cast("long") for b in bounds]).cast("array<bigint>")
    strides = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    step = lambda lo, stride: F.when(F.get(array, lo + stride - 1) <= value, lo + stride).otherwise(lo)
    at = F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), step)
    return F.when(value.isNull(), F.lit(-1)).otherwise(at)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each row with the next one in descending doc_id.

    After the last row comes the first. Rows without doc_id come last; rows of one doc_id follow each
    other in the order of their texts' hashes. Ids are cut into groups of about as many rows at
    quantiles; a group also gets the first row of the one after it, so each is looked at on its own and
    texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(20_000, max(16, docs.count() // _GROUP_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10 * n)).alias("cuts")).first().cuts
    base = docs.withColumn("g", _group_of(F.col("doc_id"), sorted(set(cuts or []))))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    first = base.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("rn = 1").drop("rn")
    groups = base.select("g").distinct()  # n rows at most
    every = Window.partitionBy(F.lit(0))
    after = groups.select("g", F.coalesce(F.lag("g").over(every.orderBy(F.desc("g"))), F.min("g").over(every)).alias("to"))
    halo = first.join(after, "g").select("doc_id", "text", F.col("to").alias("g"), F.lit(True).alias("halo"))
    rows = base.withColumn("halo", F.lit(False)).unionByName(halo).withColumn("sigs", signatures(F.col("text")))
    line = Window.partitionBy("g").orderBy("halo", *order)
    rows = rows.withColumns({"next_text": F.lead("text").over(line), "next_sigs": F.lead("sigs").over(line)})
    return rows.where("NOT halo").drop("halo", "g")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)")))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sigs")).alias("fingerprint"), as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
