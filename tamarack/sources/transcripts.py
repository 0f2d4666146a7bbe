"""Conversation transcripts in JSON lines as messages, whole or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import topics

#: What is used of a record; content stays text because it is a string or an array.
_RECORD = "struct<type:string,isMeta:boolean,cwd:string,timestamp:string,customTitle:string,aiTitle:string,message:struct<content:string>>"


def messages(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """(topic_id, msg_key, body, project, at) of lines (value, file): visible user and assistant texts.

    A line that is no whole JSON record gives nothing, as when the last line is still being written.
    The key of a message, unless given, is a hash of its line, so reading a file again gives the same keys.
    """
    r = F.from_json("value", _RECORD)
    rows = lines.select("file", (F.xxhash64("value") if key is None else key).alias("msg_key"), r.alias("r"))
    body = topics.visible_text(F.col("r.type"), F.col("r.isMeta"), F.col("r.message.content"))
    out = rows.select(topic_of(F.col("file")).alias("topic_id"), "msg_key", body.alias("body"), F.col("r.cwd").alias("project"), topics.seconds(F.col("r.timestamp")).alias("at"))
    return out.where("body IS NOT NULL AND body <> ''")


def heads(lines: DataFrame) -> DataFrame:
    """(topic_id, title, project, excerpt) of lines (file, value, offset).

    The title is the last one given to the conversation, else the first user text's 120 characters; the project is the
    first folder named, the excerpt the first message's 220 characters. What is not there is empty.
    """
    rows = lines.select(topic_of(F.col("file")).alias("topic_id"), "offset", F.from_json("value", _RECORD).alias("r"))
    body = F.nullif(topics.visible_text(F.col("r.type"), F.col("r.isMeta"), F.col("r.message.content")), F.lit(""))
    given = F.nullif(F.coalesce("r.customTitle", "r.aiTitle"), F.lit(""))
    rows = rows.select("topic_id", "offset", body.alias("body"), given.alias("given"), F.when(F.col("r.type") == "user", F.substring(body, 1, 120)).alias("asked"), F.nullif("r.cwd", F.lit("")).alias("cwd"))
    first = lambda c, n=None: F.min_by(F.substring(c, 1, n) if n else F.col(c), F.when(F.col(c).isNotNull(), F.col("offset")))
    last = F.max_by("given", F.when(F.col("given").isNotNull(), F.col("offset")))
    title = F.coalesce(last, F.replace(first("asked"), F.lit("\n"), F.lit(" ")), F.lit(""))
    return rows.groupBy("topic_id").agg(title.alias("title"), F.coalesce(first("cwd"), F.lit("")).alias("project"), F.coalesce(first("body", 220), F.lit("")).alias("excerpt"))


def topic_of(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]+)\.jsonl$", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All messages below a folder; of files with one topic the newest is used."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    newest = lines.groupBy(topic_of(F.col("file")).alias("topic_id")).agg(F.max_by("file", F.struct("changed", "file")).alias("keep"))
    kept = lines.join(newest, F.col("file") == F.col("keep"), "left_semi")
    return messages(kept)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages of files as they arrive."""
    source = spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger)).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").format("text").load(path)
    return messages(source.select("value", F.col("_metadata.file_path").alias("file")))
