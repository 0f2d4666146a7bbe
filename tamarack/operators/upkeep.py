"""A whole catalog after a batch of changes: parents, ids, types and what is left out.

A batch tells what is on disk now at some paths. Entries at paths that are gone go with all below them; an
entry whose type changed goes as well and comes back under a new id; folders that new paths need but the
catalog lacks are added. Ids of entries that stay never change, new ones follow the highest in pre-order,
so a folder's is below those of what it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .catalog import _kept
from .subtrees import above, holding, key, numbered

ENTRY = ("entry_id", "parent_id", "name", "is_dir", "size", "mtime", "rel_path", "depth", "ancestors")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def left_out(path: Column, is_dir: Column, paths: list[str], folders: list[str], extensions: list[str]) -> tuple[Column, Column]:
    """Whether a path lies in (or is) what a scan does not enter, and whether it is a file of a type that is left out."""
    under = F.lit(False)
    for p in paths:
        under = under | (path == p) | path.startswith(p.rstrip("/") + "/")
    inner = F.when(is_dir, F.split(path, "/")).otherwise(F.split(_parent(path), "/"))
    return under | F.arrays_overlap(inner, F.array(*map(F.lit, folders)).cast("array<string>")), ~is_dir & names.extension(F.substring_index(path, "/", -1)).isin(extensions)


def upkept(catalog: DataFrame, seen: DataFrame, listed: DataFrame | None = None, paths: list[str] = (), folders: list[str] = (), extensions: list[str] = ()) -> DataFrame:
    """The catalog (ENTRY columns) after a batch.

    catalog: ENTRY columns. seen: path, present, is_dir, size, mtime, event_id; of several rows of a path the last
    event counts, paths are compared with A-Z folded. listed (path, is_dir, size, mtime): what a scan found in folders that were
    new or had to be read again; it adds to seen and takes nothing away. paths, folders, extensions: what is left out: changes there
    are ignored, but for files of those types, which go. A folder that only a path below it tells of gets that path's time.
    """
    told = seen.select("path", "present", "is_dir", "size", "mtime", "event_id")
    if listed is not None:
        told = told.unionByName(listed.select("path", F.lit(True).alias("present"), "is_dir", "size", "mtime", F.lit(-1).cast("long").alias("event_id")))
    told = told.withColumn("path", F.regexp_replace("path", "(?<=.)/+$", "")).where("path <> '/'")
    last = F.max_by(F.struct("path", "present", "is_dir", "size", "mtime"), F.struct("event_id", "present", "path"))
    told = told.withColumn("at", names.fold(F.col("path"))).groupBy("at").agg(last.alias("x")).select("at", "x.*")
    hidden, typed = left_out(F.col("path"), F.col("is_dir"), list(paths), list(folders), list(extensions))
    told = _kept(told.where(~hidden).withColumn("present", F.col("present") & ~typed))
    # folders that present paths need
    needs = told.where("present").select("mtime", F.explode(above(F.col("path"))).alias("path")).groupBy(names.fold(F.col("path")).alias("at")).agg(F.max("path").alias("path"), F.max("mtime").alias("mtime"))
    is_folder = told.where("present AND is_dir").select("at")
    needs = needs.join(is_folder, "at", "left_anti").select("at", "path", F.lit(True).alias("needed"), "mtime")
    rows = catalog.select(*ENTRY, names.fold(F.col("rel_path")).alias("at"))
    # a folder that is needed is there, whatever was told of it before
    wanted = told.join(needs.select("at"), "at", "left_anti").select("at", "path", "present", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).cast("long").alias("size"), "mtime", F.lit(False).alias("needed"))
    wanted = _kept(wanted.unionByName(needs.select("at", "path", F.lit(True).alias("present"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "mtime", "needed")))
    met = _kept(rows.select("at", F.col("is_dir").alias("was_dir"), F.col("rel_path").alias("was")).join(wanted, "at"))
    absent = told.where("NOT present").select("at").join(rows.select("at", F.col("rel_path").alias("path")), "at").select("path")
    roots = met.where("NOT present OR is_dir <> was_dir").select(F.col("was").alias("path")).unionByName(absent).distinct()
    live = holding(rows, roots, name="_gone")
    # inside of what is gone only what was seen itself is there again, as something new
    live = _kept(live.where(F.size("_gone") == 0).drop("_gone"))
    now = wanted.where("present")
    change = now.where("NOT needed").select("at", F.struct(F.substring_index("path", "/", -1).alias("name"), "size", "mtime").alias("now"))
    stay = live.join(change, "at", "left")
    stay = stay.withColumns({c: F.coalesce(F.col("now")[c], F.col(c)) for c in ("name", "size", "mtime")}).select(*ENTRY)
    new = now.join(live.select("at"), "at", "left_anti").withColumn("k", key(F.col("path")))
    first = (catalog.agg(F.max("entry_id")).first()[0] or 0) + 1
    new = _kept(numbered(new, "k", first, "entry_id"))
    homes = live.where("is_dir").select("at", F.col("entry_id").alias("parent_id")).unionByName(new.where("is_dir").select("at", F.col("entry_id").alias("parent_id")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    new = new.withColumns({"up": _parent(F.col("at")), "ancestors": F.slice(parts, F.lit(1), F.size(parts) - 1), "depth": F.size(parts), "name": F.substring_index("path", "/", -1)})
    new = new.join(homes.withColumnRenamed("at", "up"), "up", "left").select("entry_id", F.coalesce("parent_id", F.lit(0)).cast("long").alias("parent_id"), "name", "is_dir", "size", "mtime", F.col("path").alias("rel_path"), "depth", "ancestors")
    return stay.unionByName(new)
