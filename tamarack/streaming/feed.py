"""A change feed applied to a catalog in micro-batches.

Each batch writes the next snapshot beside the last one; a small pointer table names the current one,
with the last event applied. A batch that is replayed after a failure finds its number there and does
nothing, so each is applied once. Readers follow the pointer and never see half a snapshot.

A batch that tells of lost events opens a gap: from then on batches are only stored, snapshot and cursor
stay, and `rescanned` closes the gap with a new listing and the stored batches. One writer at a time:
call it between micro-batches.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes

CHANGE = "path string, event_id long, flags int, present boolean, size long, mtime long"
_POINTER = "batch long, snapshot string, cursor long, gap long, turn long"


class Pointer(NamedTuple):
    batch: int  # number of the last batch taken
    snapshot: str
    cursor: int  # last event applied
    gap: int | None = None  # the batch that opened a gap
    turn: int = 0


def working_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors share; a temporary one where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="tamarack-")
    return f"{base}/feed-{uuid.uuid4().hex}"


def start_with(files: DataFrame, folder: str) -> None:
    """The first snapshot: (rel_path, size, mtime)."""
    files.select("rel_path", "size", "mtime").write.mode("overwrite").parquet(f"{folder}/snapshot-start")
    _point(files.sparkSession, folder, Pointer(-1, f"{folder}/snapshot-start", -1))


def _point(spark: SparkSession, folder: str, to: Pointer) -> None:
    spark.createDataFrame([to], _POINTER).coalesce(1).write.mode("append").json(f"{folder}/pointer")


def pointer(spark: SparkSession, folder: str) -> Pointer:
    return Pointer(*spark.read.schema(_POINTER).json(f"{folder}/pointer").orderBy(F.desc("turn")).first())


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(pointer(spark, folder).snapshot)


def _last(events: DataFrame) -> DataFrame:
    last = events.groupBy("path").agg(F.max_by(F.struct("present", "size", "mtime"), "event_id").alias("x"), F.max("event_id").alias("event_id"))
    return last.select("path", "event_id", "x.*")


def apply_batch(batch: DataFrame, number: int, folder: str, root: str = "/") -> None:
    """Apply a batch of CHANGE rows, or store it while there is a gap."""
    spark, at = batch.sparkSession, pointer(batch.sparkSession, folder)
    if number <= at.batch:
        return
    batch = batch.persist()
    try:
        lost, reached = batch.agg(F.coalesce(F.bool_or(changes.lost(root)), F.lit(False)), F.max("event_id")).first()
        if lost or at.gap is not None:
            gap = number if at.gap is None else at.gap
            batch.withColumn("lost", F.lit(lost)).write.mode("overwrite").parquet(f"{folder}/backlog-{gap}/batch={number}")
            _point(spark, folder, at._replace(batch=number, gap=gap, turn=at.turn + 1))
            return
        target = f"{folder}/snapshot-{number}"
        changes.upserted(spark.read.parquet(at.snapshot), _last(batch.where(F.col("event_id") > at.cursor)), at.cursor).write.mode("overwrite").parquet(target)
        _point(spark, folder, Pointer(number, target, at.cursor if reached is None else max(at.cursor, reached), None, at.turn + 1))
    finally:
        batch.unpersist()


def rescanned(files: DataFrame, folder: str, begun: int) -> bool:
    """Close a gap with a listing (rel_path, size, mtime) that began when `begun` was the pointer's batch.

    The stored batches are applied to it before it is published. Were events lost again after the listing
    began, nothing is published and another listing is needed: False. The cursor restarts at the last event after
    the loss, as event ids may have begun anew.
    """
    spark, at = files.sparkSession, pointer(files.sparkSession, folder)
    if at.gap is None:
        return True
    backlog = spark.read.parquet(f"{folder}/backlog-{at.gap}")
    lost = backlog.agg(F.max(F.when(F.col("lost"), F.col("batch")))).first()[0]  # null if the losing batches hold no rows
    if lost is not None and lost > begun:
        return False
    since = at.gap if lost is None else lost
    newest = F.max(F.struct("batch", "event_id", "present", "size", "mtime"))
    last = backlog.groupBy("path").agg(newest.alias("x")).select("path", "x.present", "x.size", "x.mtime", F.expr("CAST(CAST(x.batch AS DECIMAL(18,0)) * 10000000000000000000BD + x.event_id AS DECIMAL(38,0)) AS event_id"))
    target = f"{folder}/snapshot-{at.batch}-{at.turn + 1}"
    changes.upserted(files, last, -1).write.mode("overwrite").parquet(target)
    reached = backlog.where(F.col("batch") > since).agg(F.max("event_id")).first()[0]
    _point(spark, folder, Pointer(at.batch, target, -1 if reached is None else reached, None, at.turn + 1))
    return True


def follow(feed: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start applying a stream of CHANGE rows; without `every` what is there is applied and the stream ends."""
    writer = feed.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _hearing():
    """The function of a source's rows; made here so that it reaches workers as a whole, which may lack this package."""

    def heard(key: tuple, parts, state):
        """A source's rows of one micro-batch, an Arrow batch at a time, without those of retired watchers."""
        import pandas as pd

        known = state.get[0] if state.exists else None
        first: dict = {}  # of each epoch the least seq
        with tempfile.TemporaryFile() as spool:
            for rows in parts:
                for epoch, seq in rows.groupby("epoch")["seq"].min().items():
                    first[epoch] = min(seq, first.get(epoch, seq))
                pickle.dump(rows, spool, pickle.HIGHEST_PROTOCOL)
            end = spool.tell()
            spool.seek(0)
            begins = pd.Series(first, dtype=None if first else "float64").sort_index(ascending=False)
            # an epoch is heard until a later one begins; whole numbers stay so, as they may pass 53 bits
            until = begins.cummin().shift(1, **({"fill_value": 2**63 - 1} if begins.dtype.kind == "i" else {}))
            while spool.tell() < end:
                rows = pickle.load(spool)
                living = ~(rows["seq"] > rows["epoch"].map(until))
                yield rows[living & (rows["epoch"].notna() if known is None else rows["epoch"] >= known)]
        highest = max([*first, *([] if known is None else [known])], default=None)
        if highest is not None:
            state.update((int(highest),))

    return heard


def of_living_streams(feed: DataFrame) -> DataFrame:
    """The rows of a stream (source, epoch, seq, any others) that do not come from a retired watcher.

    A source's watcher is replaced now and then and counts its epoch up; what an earlier one still sends after the
    first row of a later one, by seq, is dropped. The highest epoch of each source is kept in the stream's
    state, so it also holds for later micro-batches. A source's rows of one micro-batch are read by one task, which
    keeps them in a file of its own until it knows where each epoch begins; in memory are the epochs and one Arrow batch.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return feed.groupBy("source").applyInPandasWithState(_hearing(), feed.schema, "epoch long", "append", GroupStateTimeout.NoTimeout)


def coalesced_per_window(feed: DataFrame, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Flags OR-ed and last event by path and time window, for feeds with an event time `ts`."""
    windowed = feed.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "path")
    return windowed.agg(F.bit_or("flags").alias("flags"), F.max("event_id").alias("event_id"))
