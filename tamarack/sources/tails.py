"""What JSON-lines files have gained since they were last read, by cursors of byte offsets.

A cursor holds how far a file was read and what it was then: inode, length and hash of its beginning, time,
hash of what precedes the offset. A file that was only appended to is read on from its offset; any other is
read from the start, and the messages it gave before go. Files must have the same path on every executor.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transcripts import messages, topic_of

CURSOR = "file string, identity string, reached long"
_TAIL = "file string, fresh boolean, offset long, value string, identity string"
_SAMPLE = 512
_BATCH_BYTES = 4 << 20


def _identity(f, info: os.stat_result, reached: int, length: int) -> str:
    """What an open file is at an offset, told by `length` bytes at its start and before the offset."""
    f.seek(0)
    first = hashlib.sha256(f.read(length)).hexdigest()
    f.seek(max(0, reached - length))
    return f"{info.st_ino}:{length}:{first}:{hashlib.sha256(f.read(min(length, reached))).hexdigest()}:{info.st_mtime_ns}"


def _start(f, info: os.stat_result, identity: str | None, reached: int) -> int:
    """The cursor's offset if the file still is what the cursor saw, else 0."""
    if not identity or info.st_size < reached:
        return 0
    now, stamp = _identity(f, info, reached, int(identity.split(":")[1])).rsplit(":", 1)
    same, old_stamp = identity.rsplit(":", 1)
    return reached if now == same and (info.st_size > reached or stamp == old_stamp) else 0


def _is_json(line: bytes) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def _gained(path: str, identity: str | None, reached: int) -> Iterator[tuple]:
    with open(path, "rb") as f:
        info = os.fstat(f.fileno())
        at = start = _start(f, info, identity, reached)
        if identity and start == info.st_size and (start > 0 or reached == 0):
            return
        f.seek(start)
        for line in f:
            if at + len(line) > info.st_size or not (line.endswith(b"\n") or _is_json(line)):
                break  # still being written: read again next time
            yield path, start == 0, at, line.rstrip(b"\n").decode("utf-8", "replace"), None
            at += len(line)
        yield path, start == 0, at, None, _identity(f, info, at, min(_SAMPLE, at))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _TAIL.split(", ")]
    for frame in frames:
        for row in frame.itertuples():
            known = isinstance(row.identity, str)
            rows, size = [], 0
            try:
                for r in _gained(row.file, row.identity if known else None, int(row.reached) if known else 0):
                    rows.append(r)
                    size += len(r[3] or "")
                    if size > _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            except FileNotFoundError:
                continue
            if rows:
                yield pd.DataFrame(rows, columns=names)


def tails(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """(file, fresh, offset, value, identity): lines that files (file) gained since cursors (CURSOR), with their byte offsets.

    One more row a changed file, without value, is its new cursor; fresh tells that a file was read from its
    start. Files go on growing, so write the result to a table before it is used more than once.
    """
    at = files.select("file").distinct().join(cursors, "file", "left").select("file", "identity", "reached")
    return at.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(_read, _TAIL)


def moved(cursors: DataFrame, tail: DataFrame) -> DataFrame:
    """Cursors after a tail was applied."""
    new = tail.where("value IS NULL").select("file", "identity", F.col("offset").alias("reached"))
    return cursors.join(new, "file", "left_anti").select("file", "identity", "reached").unionByName(new)


def applied(known: DataFrame, tail: DataFrame) -> DataFrame:
    """Messages (as `transcripts.messages` gives them, msg_key being the line's offset) after a tail: those of fresh files are replaced."""
    new = messages(tail.where("value IS NOT NULL"), F.col("offset"))
    fresh = tail.where("fresh").select(topic_of(F.col("file")).alias("again")).distinct()
    return known.join(fresh, (F.col("topic_id") == F.col("again")) & (F.col("msg_key") >= 0), "left_anti").unionByName(new)
