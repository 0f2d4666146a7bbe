"""The entry catalog: paths, classification, checks, reports and path lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def _kept(df: DataFrame) -> DataFrame:
    """A level that later ones build on: a checkpoint where the session has a folder for them, else cached."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def with_paths(entries: DataFrame, root_id: int = 0) -> DataFrame:
    """entries (entry_id, parent_id, name, is_dir, ...) and rel_path, depth, ancestors.

    Only folders are walked, a level at a time; files then get their folder's path in one join.
    Entries that hang on no path from the root are left out.
    """
    dirs = entries.where(F.col("is_dir") & (F.col("entry_id") != root_id)).select("entry_id", "parent_id", "name")
    none = F.array().cast("array<string>")
    level = dirs.sparkSession.range(1).select(F.lit(root_id).cast("long").alias("dir"), F.lit("").alias("dir_path"), F.lit(0).alias("dir_depth"), none.alias("dir_names"))
    known = level
    while True:
        below = dirs.join(level, dirs["parent_id"] == level["dir"])
        level = _kept(below.select(
            F.col("entry_id").alias("dir"), F.concat("dir_path", F.lit("/"), "name").alias("dir_path"),
            (F.col("dir_depth") + 1).alias("dir_depth"), F.concat("dir_names", F.array("name")).alias("dir_names"),
        ))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    at = entries.join(known, entries["parent_id"] == known["dir"])
    return at.select(*entries.columns, F.concat("dir_path", F.lit("/"), "name").alias("rel_path"), (F.col("dir_depth") + 1).alias("depth"), F.col("dir_names").alias("ancestors"))


def classified(entries: DataFrame, user_area: Column | bool = True) -> DataFrame:
    """entries with paths and folded, ext, kind, hidden, noise, in_package, user_area, alt_keys; size as kept."""
    ext = names.extension(F.col("name"))
    noisy = F.exists("ancestors", lambda a: a.isin(names.NOISE) | a.startswith("."))
    system = F.coalesce(F.get("ancestors", F.lit(0)).isin(names.SYSTEM), F.lit(False))
    library = F.coalesce((F.get("ancestors", F.lit(0)) == "Users") & (F.get("ancestors", F.lit(2)) == "Library"), F.lit(False))
    packed = F.exists("ancestors", names.is_package)
    # the table of syllables is a column for the time of one projection, since lambdas take no subqueries; it is half a MB, so only rows that need it get it
    table = "_syllables"
    entries = entries.withColumn(table, F.when(F.col("name").rlike(names.HAN), names.syllable_table(entries.sparkSession)))
    return entries.withColumns({
        "folded": names.fold(F.col("name")), "ext": ext, "kind": names.kind(F.col("name"), F.col("is_dir")), "size": names.decoded_size(F.col("size")),
        "mtime": F.least(F.greatest("mtime", F.lit(0)), F.lit(2**32 - 1)), "hidden": F.col("name").startswith("."), "noise": noisy | system | library, "in_package": packed,
        "user_area": F.lit(user_area) if isinstance(user_area, bool) else user_area, "alt_keys": names.alternate_keys(F.col("name"), F.col(table)),
    }).drop(table)


def build(entries: DataFrame) -> DataFrame:
    return classified(with_paths(entries))


def report(catalog: DataFrame) -> DataFrame:
    """One row a kind: entries, folders, clean, noise, in packages, hidden."""
    clean = F.col("user_area") & ~F.col("noise") & ~F.col("in_package") & ~F.col("hidden")
    return catalog.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("is_dir").alias("dirs"), F.count_if(clean).alias("clean"),
        F.count_if("noise").alias("noise"), F.count_if("in_package").alias("in_package"), F.count_if("hidden").alias("hidden"),
    )


def validate(entries: DataFrame) -> DataFrame:
    """One row: how many entries break each rule of a sound catalog."""
    parents = entries.where("is_dir").select(F.col("entry_id").alias("pid"))
    at = entries.join(parents, entries["parent_id"] == parents["pid"], "left")
    names_in = entries.groupBy("parent_id", names.fold(F.col("name")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    twice = names_in.agg(F.count_if(F.col("n") > 1).alias("same_name"))
    return at.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("parent_id") >= F.col("entry_id")).alias("parent_not_before"),
        F.count_if((F.col("parent_id") != 0) & F.col("pid").isNull()).alias("no_parent"), F.count_if((F.col("name") == "") | F.col("name").contains("/")).alias("bad_name"),
    ).join(F.broadcast(twice))  # fmt: skip  (one row each)


def resolve(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, entry_id): entries at given paths, case folded; null where there is none."""
    wanted = paths.select("path", names.fold(F.col("path")).alias("at"))
    return wanted.join(catalog.select(names.fold(F.col("rel_path")).alias("at"), "entry_id"), "at", "left").select("path", "entry_id")


def children(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(parent_id, name, entry_id): lookup of wanted (parent_id, name) by folded name."""
    right = catalog.select(F.col("parent_id"), F.col("folded"), "entry_id")
    return wanted.withColumn("folded", names.fold(F.col("name"))).join(right, ["parent_id", "folded"], "left").select("parent_id", "name", "entry_id")


def compacted(catalog: DataFrame) -> DataFrame:
    """Live entries (not `deleted`) under new ids that keep the order of the old ones.

    Ids are cut into ranges whose sizes are counted first, so numbering needs no single task.
    """
    live = catalog.where("NOT deleted")
    span = live.agg(F.min("entry_id"), F.max("entry_id"), F.count(F.lit(1))).first()
    width = max(1, ((span[1] or 0) - (span[0] or 0) + 1) // max(1, min(4096, (span[2] or 1) // 1000 + 1)))
    rows = live.withColumn("range", F.expr(f"(entry_id - {span[0] or 0}) div {width}"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most a few thousand ranges
    base = rows.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rows = rows.join(base, "range").withColumn("new_id", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy("entry_id")))
    return rows.drop("range", "base")


def needs_compaction(catalog: DataFrame, least: int = 100_000) -> DataFrame:
    """One row: live, deleted and whether deleted ones are more than a quarter and than `least`."""
    counts = catalog.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"))
    return counts.withColumn("compact", F.col("deleted") > F.greatest(F.lit(least), F.expr("(live + deleted) div 4")))


def rebased(catalog: DataFrame, root: str) -> DataFrame:
    """Absolute paths and depths for a catalog mounted at another root."""
    base = "" if root == "/" else root.rstrip("/")
    return catalog.withColumns({"abs_path": F.concat(F.lit(base), "rel_path"), "depth": F.col("depth") + base.count("/")})
