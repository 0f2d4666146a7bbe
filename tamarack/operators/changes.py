"""Keeping a catalog up to date from a change feed, as joins over whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .subtrees import above, holding

#: Bits of a change's flags.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, ROOT_CHANGED = 0x01, 0x02, 0x04, 0x08, 0x20
_EVENT = "decimal(38,0)"  # an event id, or a batch and an event id


def lost(root: str = "/") -> Column:
    """Whether an event (path, flags) says that others are missing: ids wrapped, the root changed, or the root is to be scanned again."""
    flags = F.col("flags")
    at_root = (F.col("path") == root) & (flags.bitwiseAND(MUST_SCAN | USER_DROPPED | KERNEL_DROPPED) != 0)
    return (flags.bitwiseAND(IDS_WRAPPED | ROOT_CHANGED) != 0) | at_root


def coalesced(changes: DataFrame) -> DataFrame:
    """One row a path: all flags OR-ed, the last event id."""
    return changes.groupBy("path").agg(F.bit_or("flags").alias("flags"), F.max("event_id").alias("event_id"))


def applied(catalog: DataFrame, seen: DataFrame, cursor: int = -1) -> DataFrame:
    """(path, op, event_id) for what is on disk now (path, present, size, mtime, event_id) against the catalog.

    Missing paths are removed, known ones updated when size or time differ, new ones inserted; events up
    to the cursor were applied before.
    """
    new = seen.where(F.col("event_id") > cursor)
    have = catalog.select(F.col("rel_path").alias("path"), F.col("entry_id"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    at = new.join(have, "path", "left")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    op = (
        F.when(~F.col("present") & F.col("entry_id").isNotNull(), F.lit("remove"))
        .when(~F.col("present"), F.lit("ignore"))
        .when(F.col("entry_id").isNull(), F.lit("insert"))
        .when(same, F.lit("keep"))
        .otherwise(F.lit("update"))
    )
    return at.select("path", op.alias("op"), "event_id", "entry_id")


def summary(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


def upserted(catalog: DataFrame, seen: DataFrame, cursor: int = -1) -> DataFrame:
    """(rel_path, size, mtime): the catalog's files after a batch (one row a path).

    With a removed path goes all that lay below it before that event.
    """
    new = seen.where(F.col("event_id") > cursor)
    old = catalog.select("rel_path", "size", "mtime", F.lit(None).cast(_EVENT).alias("event_id"))
    old = old.join(new.select(F.col("path").alias("rel_path")), "rel_path", "left_anti")
    rows = old.unionByName(new.where("present").select(F.col("path").alias("rel_path"), "size", "mtime", F.col("event_id").cast(_EVENT)))
    gone = new.where("NOT present").groupBy("path").agg(F.max(F.col("event_id").cast(_EVENT)).alias("gone"))
    inside = holding(rows, gone, name="_gone", itself=False)
    kept = ~F.exists("_gone", lambda x: F.col("event_id").isNull() | (x["gone"] > F.col("event_id")))
    return inside.where(kept).select("rel_path", "size", "mtime")


def merged(catalog: DataFrame, roots: DataFrame, listed: DataFrame) -> DataFrame:
    """(rel_path, size, mtime) after the folders at roots (path) were read again: listed takes the place of all at and below them."""
    rest = holding(catalog.select("rel_path", "size", "mtime"), roots.select("path").distinct(), name="_roots").where(F.size("_roots") == 0)
    return rest.drop("_roots").unionByName(listed.select("rel_path", "size", "mtime"))


def swept(catalog: DataFrame, removed: DataFrame) -> DataFrame:
    """catalog and `deleted`: entries at removed paths (path) and all below them."""
    return holding(catalog, removed.select("path").distinct(), name="_gone").withColumn("deleted", F.size("_gone") > 0).drop("_gone")


def reconciled(catalog: DataFrame, root: str, touched: DataFrame) -> DataFrame:
    """Entries below a rescanned root that the rescan (rel_path) did not meet."""
    return catalog.where(F.col("rel_path").startswith(root.rstrip("/") + "/")).join(touched, "rel_path", "left_anti")


def outer_roots(roots: DataFrame) -> DataFrame:
    """Roots (path) that lie below no other root: a root goes when any folder above it is a root too."""
    inner = roots.select("path", F.explode(above(F.col("path"))).alias("up")).join(roots.select(F.col("path").alias("up")), "up", "left_semi")
    return roots.join(inner.select("path").distinct(), "path", "left_anti")


def inherited(catalog: DataFrame, renamed: DataFrame) -> DataFrame:
    """catalog with `ancestors` after folders (old path from the root, new name) were renamed; flags follow from them."""
    own = catalog.withColumn("_folder", F.concat(F.lit("/"), F.array_join("ancestors", "/")))
    rows = holding(own, renamed.select(F.concat(F.lit("/"), F.ltrim(F.col("old"), F.lit("/"))).alias("path"), "new"), "_folder", "_renamed")
    new = F.map_from_entries(F.transform("_renamed", lambda x: F.struct(F.size(F.split(x["path"], "/")) - 1, x["new"])))  # by depth
    moved = F.transform("ancestors", lambda a, i: F.coalesce(F.try_element_at(F.col("_to"), i + 1), a))
    return rows.withColumn("_to", new).withColumn("ancestors", moved).drop("_renamed", "_to", "_folder")
