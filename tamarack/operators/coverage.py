"""What a scan leaves out and why."""

from __future__ import annotations

import posixpath
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import changes

EXAMPLES = 5


def _last_part(name: str) -> Column:
    """What follows a name's last dot, in small letters; empty without a dot."""
    return F.when(F.col(name).contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def _forms(exts: list[str]) -> list[str]:
    """Extensions in small letters, composed and decomposed, as names may hold either."""
    return sorted({unicodedata.normalize(form, e.lower()) for e in exts for form in ("NFC", "NFD")})


def reasons(catalog: DataFrame, excluded_paths: list[str], dependency_names: list[str], excluded_exts: list[str], hidden_ok: bool = False) -> DataFrame:
    """catalog and `reason`, the first rule that leaves an entry out, null where none does.

    Order of rules: the user's paths, hidden names, dependency folders, package insides, file types (of any
    length and script).
    """
    path = F.col("rel_path")
    own = F.lit(False)
    for p in excluded_paths:
        own = own | (path == p) | path.startswith(p.rstrip("/") + "/")
    inside = F.exists(F.concat("ancestors", F.when(F.col("is_dir"), F.array("name")).otherwise(F.array().cast("array<string>"))), lambda a: a.isin(dependency_names))
    reason = (
        F.when(own, F.lit("user path"))
        .when(F.lit(not hidden_ok) & F.col("hidden"), F.lit("hidden"))
        .when(inside, F.lit("dependency"))
        .when(F.col("in_package"), F.lit("package"))
        .when(~F.col("is_dir") & _last_part("name").isin(_forms(excluded_exts)), F.lit("file type"))
    )
    return catalog.withColumn("reason", reason)


def loose_file(folders: list[str]) -> Column:
    """Whether an entry is a plain file right in one of the folders, such as /System and the user's Library."""
    parent = F.regexp_replace("rel_path", "/[^/]*$", "")
    return ~F.col("is_dir") & parent.isin([f.rstrip("/") for f in folders])


def entered(catalog: DataFrame, packages: bool = False) -> DataFrame:
    """What a scan meets that lists packages (unless `packages`) and placeholder folders (cloud, if there) without entering them."""
    rows = catalog if packages else catalog.where("NOT in_package")
    if "cloud" not in catalog.columns:
        return rows
    closed = catalog.where("is_dir AND cloud").select(F.col("rel_path").alias("up"))
    inside = rows.select("rel_path", F.explode(changes.above(F.col("rel_path"))).alias("up")).join(closed, "up", "left_semi")
    return rows.join(inside.select("rel_path").distinct(), "rel_path", "left_anti")


def counters(left_out: DataFrame) -> DataFrame:
    """(reason, n, examples): how many entries and the first paths by entry id."""
    first = Window.partitionBy("reason").orderBy("entry_id")
    some = left_out.where("reason IS NOT NULL").select("reason", "rel_path", "entry_id", F.row_number().over(first).alias("k")).where(F.col("k") <= EXAMPLES)
    shown = some.groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("k", "rel_path"))).alias("e"))
    counts = left_out.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, "reason").select("reason", "n", F.array_join(F.transform("e", lambda x: x["rel_path"]), ";").alias("examples"))


def merged(parts: DataFrame) -> DataFrame:
    """Counters (reason, n, examples) of several scans added up; examples, if there, go on in the scans' order up to EXAMPLES."""
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")]
    if "examples" in parts.columns:  # one row a scan and reason
        listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "examples"))), lambda x: F.split(x["examples"], ";")))
        sums.append(F.array_join(F.slice(listed, 1, EXAMPLES), ";").alias("examples"))
    return parts.groupBy("reason").agg(*sums)


def uncovered(all_roots: DataFrame, indexed: DataFrame) -> DataFrame:
    """Roots (root) that no indexed source has."""
    return all_roots.join(indexed, "root", "left_anti")


def uncovered_summary(all_roots: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: how many roots no indexed source has, and the first EXAMPLES of them."""
    rest = uncovered(all_roots.select("root").distinct(), indexed)
    first = rest.orderBy("root").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("root")), ";").alias("examples"))
    return rest.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first))  # one row each


def normalized(path: str) -> str | None:
    """An absolute path in NFC without doubled or closing slashes and without `.` and `..`; None for other texts."""
    if not path.startswith("/"):
        return None
    return unicodedata.normalize("NFC", posixpath.normpath(re.sub("/+", "/", path)))


def holds(parent: str, path: str) -> bool:
    """Whether path is parent or lies below it."""
    a, b = normalized(parent), normalized(path)
    return a is not None and b is not None and (a == "/" or a == b or b.startswith(a + "/"))


def with_exclusions(existing: list[str], new: list[str]) -> list[str]:
    """Excluded folders after new ones were chosen: none lies in another, and a new outer folder takes the place of inner ones."""
    kept: list[str] = []
    for path in filter(None, map(normalized, existing + new)):
        if not any(holds(p, path) for p in kept):
            kept = [*(p for p in kept if not holds(path, p)), path]
    return kept


def explained(paths: DataFrame, judged: DataFrame, excluded_paths: list[str], root: str = "/") -> DataFrame:
    """(path, told, detail): why each path is or is not in the index.

    judged: what a scan met, as `reasons` gives it (rel_path, reason), and, if it has them, no_access and
    cloud (boolean). The first of these holds: indexed, volume (below /Volumes, unless the root is one),
    excluded by the user (detail: the folder), file type (detail: the extension), another reason of the scan,
    no access, cloud, and pending for what no scan has met.
    """
    path = F.col("path")
    flags = {c: F.col(c) if c in judged.columns else F.lit(False) for c in ("no_access", "cloud")}
    known = judged.select(F.col("rel_path").alias("met"), "reason", *[x.alias(c) for c, x in flags.items()])
    own = F.lit(None).cast("string")
    for p in reversed(excluded_paths):
        own = F.when((path == p) | path.startswith(p.rstrip("/") + "/"), F.lit(p)).otherwise(own)
    inside = F.lit(root.startswith("/Volumes/")) & ((path == root) | path.startswith(root.rstrip("/") + "/"))
    volume = ((path == "/Volumes") | path.startswith("/Volumes/")) & ~inside
    met, free = F.col("met").isNotNull(), F.coalesce(~F.col("no_access") & ~F.col("cloud"), F.lit(False))
    told = (
        F.when(met & F.col("reason").isNull() & free, "indexed")
        .when(volume, "volume")
        .when(own.isNotNull(), "user excluded")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.coalesce("no_access", F.lit(False)), "no access")
        .when(F.coalesce("cloud", F.lit(False)), "cloud")
        .otherwise("pending")
    )
    detail = F.when(F.col("told") == "user excluded", own).when(F.col("told") == "file type", _last_part("met"))
    return paths.join(known, paths["path"] == known["met"], "left").withColumn("told", told).select("path", "told", detail.alias("detail"))
