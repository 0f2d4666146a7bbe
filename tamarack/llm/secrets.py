"""Secret scans over an incremental blob ledger.

Every row is a historical version of some path and is addressed by its content (SHA-256 of the UTF-8
text). A ledger of (blob, rule, version, findings) holds what was scanned before; only pairs that it
lacks are scanned, each distinct blob once, and old and new findings of the rules' current versions are
joined back to every path that has the blob.

A cheap test on the JVM side decides which texts can hold a secret at all; only those travel through
the shuffle by blob, the others as their address alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, storage

#: Kind, version, pattern, least length of the span, group whose length counts.
RULES = {
    "assign": (1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    "access": (1, re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (1, re.compile(r"[0-9a-f]+"), 24, 0),
    "pem": (1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 0),
    "github": (1, re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 40, 0),
    "slack": (1, re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 20, 0),
    "jwt": (1, re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 40, 0),
}
BASE = ("assign", "access", "hex")
#: The same matches found in linear time: a run of letters is entered at its start only, and once.
_RUN = "[A-Za-z0-9_-]"
_LINEAR = {"jwt": re.compile(rf"(?<!{_RUN})(?>{_RUN}*?(?=eyJ))(?P<span>eyJ{_RUN}++\.eyJ{_RUN}++\.{_RUN}+)")}
#: Every text in which a rule can succeed matches this.
_MAYBE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
    r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|\.eyJ[A-Za-z0-9_-]"
)
_SPANS = "array<struct<kind:string,start:long,end:long>>"
_LEDGER = f"blob string, rule string, version int, findings {_SPANS}"


def spans_of(text: str, rules: list[str]) -> list[dict]:
    """All spans of the rules, by start, then in the rules' order; code points, end exclusive."""
    found = []
    for k, kind in enumerate(RULES):
        if kind in rules:
            _, pattern, least, group = RULES[kind]
            if linear := _LINEAR.get(kind):
                found += [(m.start("span"), k, m.end(), kind) for m in linear.finditer(text) if len(m["span"]) >= least]
            else:
                found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(found)]


def address(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(blob, rules, findings): each blob that has rules the ledger (blob, rule, version) lacks."""
    blocks.small_batches(docs.sparkSession)
    maybe = F.when(F.col("text").rlike(_MAYBE), F.col("text"))
    blobs = docs.select(address(F.col("text")).alias("blob"), maybe.alias("text")).groupBy("blob").agg(F.max("text").alias("text"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v[0]).alias("version")) for k, v in RULES.items()])
    if ledger is None:
        pending = blobs.select("blob", "text", rules["rule"].alias("rules"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))  # as many as rule versions
        left = F.array_except(rules, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>")))
        pending = blobs.join(seen, "blob", "left").select("blob", "text", left["rule"].alias("rules")).where(F.size("rules") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            pairs = zip(batch.column("text"), batch.column("rules"), strict=True)
            found = [spans_of(t.as_py(), r.as_py()) for t, r in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], ["blob", "rules", "findings"])

    schema = f"blob string, rules array<string>, findings {_SPANS}"
    clean = pending.where("text is null").select("blob", "rules", F.array().cast(_SPANS).alias("findings"))
    return pending.where("text is not null").mapInArrow(scan, schema).unionByName(clean)


def _versions() -> Column:
    return F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[0])])


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """What to append to the ledger after `scan_blobs`: (blob, rule, version, findings of that rule)."""
    each = scanned.select("blob", F.explode("rules").alias("rule"), "findings")
    return each.select("blob", "rule", _versions()[F.col("rule")].alias("version"), F.filter("findings", lambda x: x["kind"] == F.col("rule")).alias("findings"))


def stored_findings(ledger: DataFrame) -> DataFrame:
    """(blob, findings) of one rule each, where the ledger has findings of the rule's current version."""
    return ledger.where((F.col("version") == _versions()[F.col("rule")]) & (F.size("findings") > 0)).select("blob", "findings")


def _by_blob(hits: DataFrame) -> DataFrame:
    """(blob, findings): each blob's findings in one array, by start, then in the rules' order."""
    kinds = F.array(*map(F.lit, RULES))
    ranked = F.transform(F.flatten(F.collect_list("findings")), lambda x: F.struct(x["start"], F.array_position(kinds, x["kind"]).alias("rank"), x["end"], x["kind"]))
    spans = F.transform(F.array_sort(F.array_distinct("ranked")), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return hits.groupBy("blob").agg(ranked.alias("ranked")).select("blob", spans.cast(_SPANS).alias("findings"))


def through_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger at path, made or extended by what the blobs of docs still lacked there."""
    spark = docs.sparkSession
    ledger = spark.read.schema(_LEDGER).parquet(path) if storage.exists(spark, path) else None
    ledger_rows(scan_blobs(docs, ledger)).write.mode("append").parquet(path)
    return spark.read.schema(_LEDGER).parquet(path)


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """All columns of docs and `findings`, spans of secrets in its text.

    One row per row of docs; null and empty texts have none, repeated rows each get their blob's
    findings, and without rows there are no rows. A column named findings or blob is refused.
    With a ledger (as `ledger_rows` gives it), what it holds is taken from there and only the rest is scanned.
    """
    if {"findings", "blob"} & {*docs.columns}:
        raise ValueError("documents already have a column findings or blob")
    hits = scan_blobs(docs, ledger).where(F.size("findings") > 0).select("blob", "findings")
    if ledger is not None:
        if "findings" not in ledger.columns:
            raise ValueError("the ledger has no column findings")
        hits = _by_blob(hits.unionByName(stored_findings(ledger)))
    hits = storage.kept(hits)  # its size decides whether texts are shuffled for the join
    paths = docs.withColumn("blob", address(F.col("text")))
    none = F.array().cast(_SPANS)
    return paths.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", none)).drop("blob")


def redacted(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """The text with each maximal run of covered code points replaced by the mask; findings are ordered by start."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if not (found := found.as_py()):
                out.append(text.as_py())
                continue
            whole, parts, at = text.as_py() or "", [], None
            for x in found:
                if at is None or x["start"] > at:
                    parts += [whole[at or 0 : x["start"]], mask]
                at = max(at or 0, x["end"])
            out.append("".join([*parts, whole[at:]]))
        return pa.array(out, pa.string())

    return cover(text, findings)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_secrets(spark, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """The contract's digest of `find_secrets` over whole documents.

    ledger: path of a ledger to read and extend. By default a new one in the shared folder, which is
    filled in two increments, as it would be day by day: half of the documents by hash of doc_id, then all,
    of which only blobs without an entry are scanned.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = ledger or f"{storage.shared_folder(spark)}/secrets-ledger-{uuid.uuid4().hex}"
    if not ledger:
        through_ledger(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), path)
    # only addresses and findings go through the join, not texts
    ids = docs.select("doc_id", address(F.col("text")).alias("blob"))
    hits = _by_blob(stored_findings(through_ledger(docs, path)))
    found = ids.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(_SPANS)))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))
