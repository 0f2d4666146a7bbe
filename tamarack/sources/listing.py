"""Folder trees: as a Spark data source, and walked in rounds that share out what is found.

`spark.read.format("tree").load(path)` has one partition for each folder at `split_depth` levels below the
root; filters that say what a path begins with, or does not, keep the scan out of other folders where
spark.sql.python.filterPushdown.enabled is set. `walked`
begins with the root: a task lists folders until it has met a number of entries and gives back those it has not
come to, which the next round deals out anew. So neither many folders in one place nor deep ones hold up a task.
Links are listed but not followed. The tree must be reachable from every executor.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, Not, StringStartsWith

from ..functions import names
from ..operators.catalog import _kept
from ..operators.scope import Scope

SCHEMA = "path string, parent string, name string, is_dir boolean, is_link boolean, size bigint, mtime bigint"
#: Fixed value: the file flag of what has its data elsewhere.
PLACEHOLDER = 0x40000000


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, depth: int, packages: bool):
        self.root, self.depth, self.packages = root.rstrip("/") or "/", depth, packages
        self.only, self.never = [], []

    def _wanted(self, folder: str) -> bool:
        """Whether paths below a folder can pass the filters."""
        below = "/" + os.path.relpath(folder, self.root) + "/"
        return not any(below.startswith(x) for x in self.never) and all(below.startswith(x) or x.startswith(below) for x in self.only)

    def _scan(self, folder: str) -> Iterator[tuple[os.DirEntry, os.stat_result, bool, bool]]:
        """Entries of a folder by name, with their data, whether each is a folder, and whether that is entered."""
        try:
            found = sorted(os.scandir(folder), key=lambda x: x.name)
        except OSError:
            return  # no access: its absence shows in coverage
        for x in found:
            try:
                info, is_dir = x.stat(follow_symlinks=False), x.is_dir(follow_symlinks=False)
            except OSError:
                continue  # gone since the folder was read
            package = "." in x.name and x.name.rpartition(".")[2].lower() in names.PACKAGES
            yield x, info, is_dir, is_dir and (self.packages or not package) and not getattr(info, "st_flags", 0) & PLACEHOLDER and self._wanted(x.path)

    def partitions(self) -> list[_Part]:
        """Upper folders are listed flat; those `depth` levels down with all below them."""
        parts, level = [], [self.root]
        for _ in range(self.depth):
            parts += [_Part(f, False) for f in level]
            level = [x.path for f in level for x, _, _, entered in self._scan(f) if entered]
        return parts + [_Part(f, True) for f in level]

    def read(self, partition: _Part) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            for x, info, is_dir, entered in self._scan(waiting.pop()):
                rel = "/" + os.path.relpath(x.path, self.root)
                yield rel, os.path.dirname(rel), unicodedata.normalize("NFC", x.name), is_dir, x.is_symlink(), 0 if is_dir else info.st_size, int(info.st_mtime)
                if entered and partition.deep:
                    waiting.append(x.path)


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep out of folders that no wanted path lies in; Spark still applies all filters to the rows."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, StringStartsWith) and inner.attribute == ("path",):
                (self.never if isinstance(f, Not) else self.only).append(inner.value)
        return filters


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _Pushed if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("split_depth", "1")), self.options.get("packages", "false") == "true")


def listing(spark: SparkSession, root: str, split_depth: int = 1, packages: bool = False) -> DataFrame:
    """All below root. Packages (unless `packages`) and folders that are only placeholders are listed but not entered."""
    spark.dataSource.register(TreeSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("tree").options(split_depth=str(split_depth), packages=str(packages).lower(), pushdown=pushdown).load(root)


#: Entries that a task of `walked` lists before it gives back the folders it has not come to.
AT_ONCE = 50_000
_WALKED = f"{SCHEMA}, reason string, pending boolean"


def _walk(root: str, scope: Scope, at_once: int, given: list[str]) -> Iterator[tuple]:
    """Rows of _WALKED below the given folders (paths from the root)."""
    waiting, met = given[::-1], 0
    while waiting:
        folder = waiting.pop()
        if met >= at_once:
            yield folder, None, None, None, None, None, None, None, True
            continue
        where = root.rstrip("/") + ("" if folder == "/" else folder)
        try:
            found = sorted(os.scandir(where or "/"), key=lambda x: x.name)
        except OSError:
            yield folder, None, None, True, None, None, None, "no access", False
            continue
        for x in found:
            met += 1
            path = f"{'' if folder == '/' else folder}/{x.name}"
            try:
                info, is_dir, is_link = x.stat(follow_symlinks=False), x.is_dir(follow_symlinks=False), x.is_symlink()
            except OSError:
                continue  # gone since the folder was read
            reason = scope.reason_of(path, is_dir) or (("library" if folder == scope.library else "system") if not is_dir and scope.filters_files(folder) else None)
            yield path, folder, unicodedata.normalize("NFC", x.name), is_dir, is_link, 0 if is_dir else info.st_size, int(info.st_mtime), reason, False
            package = not scope.packages and "." in x.name and x.name.rpartition(".")[2].translate(names.ASCII_LOWER) in names.PACKAGES
            if is_dir and reason is None and not package and not getattr(info, "st_flags", 0) & PLACEHOLDER:
                waiting.append(path)


def walked(spark: SparkSession, root: str, scope: Scope = Scope(), at_once: int = AT_ONCE) -> DataFrame:
    """All below root as in SCHEMA, and `reason`: why an entry is left out; what lies in such a folder is not looked at.

    A folder that cannot be read has a row of its own with the reason `no access`. Paths in scope begin at the root.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        fields = [x.split()[0] for x in _WALKED.split(", ")]
        rows = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], fields)
            rows.clear()
            return made

        given = [p for batch in batches for p in batch.column("path").to_pylist()]
        for row in _walk(root, scope, at_once, given):
            rows.append(row)
            if len(rows) >= 5000:
                yield out()
        if rows:
            yield out()

    frontier, all_rows = spark.createDataFrame([("/",)], "path string"), None
    while True:
        met = _kept(frontier.mapInArrow(run, _WALKED))
        rows = met.where("NOT pending").drop("pending")
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
        frontier = met.where("pending").select("path")
        if frontier.isEmpty():
            return all_rows
        frontier = frontier.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_entries(listed: DataFrame) -> DataFrame:
    """Entries with ids: a hash of the path, 0 for the root."""
    key = lambda c: F.when(F.col(c) == "/", F.lit(0)).otherwise(F.xxhash64(c))
    return listed.select(key("path").alias("entry_id"), key("parent").alias("parent_id"), "name", "is_dir", "size", "mtime")
