"""Which folders of a given set rows lie in, by one sort of their paths.

With the slash below all other characters, paths in order are a tree in pre-order: a folder and all below it
are one interval. Folders of a set that do not hold each other are disjoint intervals, so a row can only lie
in the last one that begins before it. A set is therefore told apart by how many of its own folders hold a
folder (its level), rows and folders are sorted together by range, and for each level the last folder is
carried along, from one range to the next too. No row is multiplied by its depth, and no key gathers more
than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import _kept


def key(path: Column) -> Column:
    """Paths in this order are the tree in pre-order; `/` comes first."""
    return F.when(path == "/", F.lit("")).otherwise(F.replace(path, F.lit("/"), F.lit("\0")))


def above(path: Column) -> Column:
    """Paths of all folders that a path lies in, but the root."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.filter(ups, lambda up: up != path)


def numbered(rows: DataFrame, by: str | list[Column], start: int, name: str) -> DataFrame:
    """rows and `name`: start, start + 1 ... in the order `by`; each range is counted first, then numbered on its own."""
    by = [by] if isinstance(by, str) else by
    rows = _kept(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(back), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return rows.join(base, "_part").withColumn(name, F.col("_base") + nth + (start - 1)).drop("_part", "_base")


def holding(rows: DataFrame, folders: DataFrame, path: str = "rel_path", name: str = "held", itself: bool = True) -> DataFrame:
    """rows and `name`: an array of the folders that hold each row, outermost first, as structs of all columns of folders.

    folders: path, any others; one row each. With itself a folder holds its own row, too. Rows below top folders
    in which no folder of the set lies are left where they are, with an empty array.
    """
    one = F.struct(*[F.col(c) for c in folders.columns])
    over = folders.select("path", F.explode(F.concat(above(F.col("path")), F.array(F.lit("/")))).alias("up")).where("path <> up")
    levels = over.join(folders.select(F.col("path").alias("up")), "up", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("level"))
    marks = _kept(folders.select("path", one.alias("mark")).join(levels, "path", "left").select(key(F.col("path")).alias("k"), F.coalesce("level", F.lit(0)).alias("level"), "mark"))
    told = marks.agg(F.max("level").alias("deep"), F.bool_or(F.col("k") == "").alias("all")).first()
    kind = f"array<{folders.select(one).schema[0].dataType.simpleString()}>"
    if told.deep is None:
        return rows.withColumn(name, F.array().cast(kind))
    top = lambda p: F.substring_index(F.substring(p, 2, 2**31 - 1), "\0", 1)
    own, rest = rows.withColumns({"_k": key(F.col(path)), "_tag": F.lit(1)}), None
    if not told["all"]:
        tops = marks.select(top(F.col("k")).alias("_top")).distinct()
        own = own.withColumn("_top", top(F.col("_k")))
        rest = own.join(tops, "_top", "left_anti").drop("_top", "_k", "_tag").withColumn(name, F.array().cast(kind))
        own = own.join(tops, "_top", "left_semi").drop("_top")
    both = own.unionByName(marks.select(F.col("k").alias("_k"), F.lit(0).alias("_tag"), "level", "mark"), allowMissingColumns=True)
    both = _kept(both.repartitionByRange("_k", "_tag").withColumn("_part", F.spark_partition_id()))
    deep = range(told.deep + 1)
    mark = lambda n: F.when((F.col("_tag") == 0) & (F.col("level") == n), F.struct("_k", "mark"))
    ends = both.groupBy("_part").agg(*[F.max_by(mark(n), F.when(mark(n).isNotNull(), F.col("_k"))).alias(f"_end{n}") for n in deep])
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select("_part", *[F.last(f"_end{n}", ignorenulls=True).over(back).alias(f"_end{n}") for n in deep])
    line = Window.partitionBy("_part").orderBy("_k", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    met = both.select("*", *[F.last(mark(n), ignorenulls=True).over(line).alias(f"_own{n}") for n in deep]).where("_tag = 1").join(ends, "_part")
    inside = lambda x: F.col("_k").startswith(F.concat(x["_k"], F.lit("\0"))) | ((F.col("_k") == x["_k"]) & F.lit(itself))
    last = [F.coalesce(f"_own{n}", f"_end{n}") for n in deep]
    held = F.transform(F.filter(F.array(*last), lambda x: x.isNotNull() & inside(x)), lambda x: x["mark"])
    out = met.select(*rows.columns, held.cast(kind).alias(name))
    return out if rest is None else rest.select(*out.columns).unionByName(out)
