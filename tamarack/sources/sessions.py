"""Session metadata as topics: descriptor files, thread tables, transcript headers, sessions of one account.

Each function gives (topic_id, title, project, modified, archived, excerpt, ...), modified in seconds. JSON
comes as text columns, tables of other stores as DataFrames with the columns they happen to have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import topics
from .transcripts import topic_of

TITLE, EXCERPT = 120, 220
HEADER_BYTES = 128 * 1024
SNAPSHOT_BYTES, SNAPSHOT_DAYS = 4096, 30
#: Fields and marks of the formats that are read.
_DESCRIPTOR = "struct<sessionId:string,cliSessionId:string,title:string,cwd:string,lastActivityAt:string,createdAt:string,isArchived:boolean,postTurnSummary:string>"
_HEADER = "struct<type:string,payload:struct<id:string,cwd:string,source:string>>"
_SNAPSHOT = "struct<primary:struct<version:int,uid:string,nickname:string,type:string,savedAt:double>>"
_SETTINGS = "struct<conversationTags:map<string,string>>"
_QUICK = "wbQuickAsk"
_HELPERS = ("subagent", "guardian_review")
_SESSION_ID = "^[A-Za-z0-9_-]{1,256}$"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _short_title(x: Column) -> Column:
    return F.replace(F.substring(_text(x), 1, TITLE), F.lit("\n"), F.lit(" "))


def _column(rows: DataFrame, name: str, default: object) -> Column:
    """A column that is null or missing in older tables counts as its default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)


def descriptors(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Topics of descriptor files (file, value: the whole text), with desktop_id.

    What is no JSON or has no session id gives nothing; of several files for one topic the latest holds, then
    the last path. An empty title, project or excerpt is taken from known topics, if those are given.
    """
    rows = files.select("file", F.from_json("value", _DESCRIPTOR).alias("d")).where("d.sessionId IS NOT NULL")
    one = rows.select(
        F.coalesce("d.cliSessionId", "d.sessionId").alias("topic_id"), F.col("d.sessionId").alias("desktop_id"),
        _text(F.col("d.title")).alias("title"), _text(F.col("d.cwd")).alias("project"),
        F.coalesce(topics.seconds(F.col("d.lastActivityAt")), topics.seconds(F.col("d.createdAt")), F.lit(0.0)).alias("modified"),
        F.coalesce("d.isArchived", F.lit(False)).alias("archived"), F.substring(_text(F.col("d.postTurnSummary")), 1, EXCERPT).alias("excerpt"), "file",
    )
    last = one.groupBy("topic_id").agg(F.max_by(F.struct(*[c for c in one.columns if c not in ("topic_id", "file")]), F.struct("modified", "file")).alias("x"))
    last = last.select("topic_id", "x.*")
    if known is None:
        return last
    old = known.select("topic_id", *[F.col(c).alias(f"old_{c}") for c in ("title", "project", "excerpt")])
    kept = {c: _text(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"old_{c}"))) for c in ("title", "project", "excerpt")}
    return last.join(old, "topic_id", "left").withColumns(kept).select(*last.columns)


def threads(rows: DataFrame) -> DataFrame:
    """Topics of a thread table (id and title; name, cwd, updated_at_ms, updated_at, rollout_path, archived,
    first_user_message, thread_source and source if there), with transcript; threads of helpers are left out."""
    by, origin = _column(rows, "thread_source", ""), _column(rows, "source", "")
    ms = (F.col("updated_at_ms") / 1000.0) if "updated_at_ms" in rows.columns else F.lit(None).cast("double")
    title = F.coalesce(F.nullif(_column(rows, "name", ""), F.lit("")), F.col("title"))
    own = rows.where(~by.isin(*_HELPERS) & ~origin.contains("subagent") & ~origin.contains("guardian"))
    return own.select(
        F.col("id").alias("topic_id"), _short_title(title).alias("title"), _column(rows, "cwd", "").alias("project"),
        F.coalesce(ms, _column(rows, "updated_at", 0).cast("double")).alias("modified"), (_column(rows, "archived", 0) != 0).alias("archived"),
        F.substring(_column(rows, "first_user_message", ""), 1, EXCERPT).alias("excerpt"), _column(rows, "rollout_path", "").alias("transcript"),
    )


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, changed): the first line of each JSON-lines file below a folder."""
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(meta["file_path"].alias("file"), meta["file_modification_time"].cast("double").alias("changed"), meta["file_block_start"].alias("block"), "value")
    at = lines.where("block = 0").withColumn("at", F.monotonically_increasing_id())  # rows of a block come in the file's order
    return at.groupBy("file", "changed").agg(F.min_by("value", "at").alias("value")).select("file", "value", "changed")


def headers(lines: DataFrame, known: DataFrame | None = None, imported: DataFrame | None = None) -> DataFrame:
    """Topics of transcripts told by their first lines (file, value, changed), with transcript; titles are still empty.

    Only whole `session_meta` lines of up to HEADER_BYTES count, and none of a helper's session. Where thread metadata are
    at hand (known: topic_id, project, archived), only its topics are taken and its project and archive flag hold;
    topics whose text came from elsewhere (imported: topic_id) are left out. Of a topic's files the newest is used.
    """
    h = lines.where(F.octet_length("value") <= HEADER_BYTES).select("file", "changed", F.from_json("value", _HEADER).alias("h"))
    helper = F.map_contains_key(F.from_json("h.payload.source", "map<string,string>"), F.lit("subagent"))
    h = h.where((F.col("h.type") == "session_meta") & F.col("h.payload.id").isNotNull() & ~F.coalesce(helper, F.lit(False)))
    rows = h.groupBy(F.col("h.payload.id").alias("topic_id")).agg(F.max_by(F.struct(_text(F.col("h.payload.cwd")).alias("project"), F.col("file").alias("transcript"), F.col("changed").alias("modified")), F.struct("changed", "file")).alias("x"))
    rows = rows.select("topic_id", F.lit("").alias("title"), "x.project", "x.modified", F.col("x.transcript").contains("/archived_sessions/").alias("archived"), F.lit("").alias("excerpt"), "x.transcript")
    if known is not None:
        told = known.select("topic_id", F.col("project").alias("told_project"), F.col("archived").alias("told_archived"))
        rows = rows.join(told, "topic_id").withColumns({"project": F.col("told_project"), "archived": F.col("told_archived")}).select(*rows.columns)
    return rows if imported is None else rows.join(imported.select("topic_id"), "topic_id", "left_anti")


def account(snapshots: DataFrame, now: int) -> DataFrame:
    """(uid) told by a snapshot file (value); none when it is damaged, too long or older than SNAPSHOT_DAYS."""
    p = snapshots.where(F.octet_length("value") <= SNAPSHOT_BYTES).select(F.from_json("value", _SNAPSHOT).alias("s")).select("s.primary.*")
    whole = "version = 1 AND uid <> '' AND nickname IS NOT NULL AND type IS NOT NULL AND savedAt IS NOT NULL AND NOT isnan(savedAt)"
    return p.where(whole).where(F.lit(now * 1000.0) - F.col("savedAt") <= SNAPSHOT_DAYS * 86_400_000.0).select("uid").distinct()


def sessions(rows: DataFrame, accounts: DataFrame, quick: DataFrame | None = None) -> DataFrame:
    """Topics of the local sessions of an account (uid), and of those without one; without an account there are none.

    rows: id, cwd, user_id, title, status, created_at, updated_at, deleted_at (times in milliseconds), and
    custom_title, last_activity_at, session_settings and transport if there. Deleted sessions, ids of other
    forms, unreadable settings and quick questions, by tag or by id (quick: topic_id), are left out.
    """
    users = accounts.select(F.col("uid").alias("user_id")).unionByName(accounts.select(F.lit("").alias("user_id"))).distinct()
    settings = _column(rows, "session_settings", "")
    tags = F.from_json(settings, _SETTINGS)
    readable = (settings == "") | (F.ltrim(settings).startswith("{") & F.get_json_object(settings, "$").isNotNull())
    asked = F.coalesce(F.try_element_at(tags["conversationTags"], F.lit(_QUICK)) == "1", F.lit(False))
    own = rows.where(F.col("deleted_at").isNull() & F.col("id").rlike(_SESSION_ID) & (_column(rows, "transport", "local") == "local") & readable & ~asked)
    own = own.join(users, "user_id", "left_semi")
    title = F.coalesce(F.nullif(_column(rows, "custom_title", ""), F.lit("")), F.col("title"))
    out = own.select(
        F.col("id").alias("topic_id"), _short_title(title).alias("title"), _text(F.col("cwd")).alias("project"),
        (F.greatest("updated_at", _column(rows, "last_activity_at", 0), "created_at") / 1000.0).alias("modified"),
        F.coalesce(F.lower("status") == "archived", F.lit(False)).alias("archived"), F.lit("").alias("excerpt"),
    )
    return out if quick is None else out.join(quick.select("topic_id"), "topic_id", "left_anti")


def with_logs(found: DataFrame, logs: DataFrame, aliases: DataFrame) -> DataFrame:
    """found and `transcript`: the newest log (file, changed) named after the topic, else the one of its alias (topic_id, alias)."""
    newest = logs.groupBy(topic_of(F.col("file")).alias("log")).agg(F.max_by("file", F.struct("changed", "file")).alias("transcript"))
    own = newest.select(F.col("log").alias("topic_id"), F.col("transcript").alias("own"))
    other = aliases.where(F.col("alias").rlike(_SESSION_ID)).join(newest.withColumnRenamed("log", "alias"), "alias")
    other = other.groupBy("topic_id").agg(F.max("transcript").alias("other"))
    rows = found.join(own, "topic_id", "left").join(other, "topic_id", "left")
    return rows.withColumn("transcript", F.coalesce("own", "other")).drop("own", "other")
