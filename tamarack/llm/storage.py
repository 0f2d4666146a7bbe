"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a folder of our own that is then set.

    On a cluster a folder of the driver's machine would be out of the executors' reach, so that is refused.
    """
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tamarack-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, whose size Spark knows when it plans a join with it."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def packed(df: DataFrame, used: list[str], rest: str = "_rest") -> DataFrame:
    """The used columns, those that df has, and all others in one struct, where their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*[c for c in used if c in df.columns], F.struct(*others).alias(rest) if others else F.lit(None).cast("string").alias(rest))


def unpacked(df: DataFrame, columns: list[str], rest: str = "_rest", also: Sequence[Column] = ()) -> DataFrame:
    """The columns as they were before `packed`, and some more."""
    inside = {f.name for f in df.schema[rest].dataType} if df.schema[rest].dataType.typeName() == "struct" else set()
    return df.select(*[F.col(f"{rest}.`{c}`") if c in inside else F.col(f"`{c}`") for c in columns], *also)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever its file system is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stash:
    """Parquet tables in the shared folder that are deleted when the block ends.

    For steps that read a wide intermediate more than once. What a block returns must not read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Stash:
        return self

    def keep(self, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        path = f"{shared_folder(self.spark)}/stash-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
