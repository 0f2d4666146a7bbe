"""Scopes as Columns and in tasks, walks in rounds, filters that reach the scan, watchers that are replaced."""

import os
import random
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarack.operators import catalog
from tamarack.operators.scope import Scope
from tamarack.sources import listing
from tamarack.streaming import feed

SCOPES = [
    Scope(), Scope(library="/Users/me/Library"), Scope(library="/Users/me/Library", limited=True), Scope(("/usr/x", "/a"), extensions=("Zip", "été", "tar.gz"), packages=True, dependencies=None),
    Scope(system_roots=None, system=None, always_paths=("/dev",), extensions=("md",)), Scope(("/",)),
]


@pytest.mark.parametrize("scope", SCOPES)
def test_columns_and_tasks_agree(spark, scope):
    rng = random.Random(1)
    words = ["Users", "me", "Library", "System", "Applications", "usr", "x", "a", "node_modules", ".git", "App.app", "B.APP", "f.zip", "f.été", "f.été", "f.md", "Mobile Documents", "Containers", "dev", ".Trashes", "x.", "usrx", "été.tar.gz"]
    rows = [("/" + "/".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), rng.random() < 0.5) for _ in range(3000)] + [("/", True)]
    got = spark.createDataFrame(rows, "p string, d boolean").select("p", "d", scope.reason(F.col("p"), F.col("d")).alias("r")).collect()
    assert [(r.p, r.d, r.r) for r in got] == [(p, d, scope.reason_of(p, d)) for p, d in rows]


def test_walks_share_out_what_they_find(spark, tmp_path):
    """Very many folders in one, and a deep one, in small portions; what is left out has a reason and is not entered."""
    for k in range(300):
        (tmp_path / "wide" / f"d{k}").mkdir(parents=True)
        (tmp_path / "wide" / f"d{k}" / "f.txt").write_text("x" * k)
    deep = tmp_path / "deep"
    for _ in range(30):
        deep = deep / "n"
    deep.mkdir(parents=True)
    for p in ("node_modules/in", "P.app/Contents", "Library/Caches", "Library/Mobile Documents/in"):
        (tmp_path / p).mkdir(parents=True)
    for p in ("node_modules/in/x", "P.app/Contents/y", "Library/loose", "Library/Mobile Documents/in/z", "a.zip"):
        (tmp_path / p).write_text("")
    os.symlink(tmp_path / "wide", tmp_path / "link")
    scope = Scope(library="/Library", system_roots=None, extensions=("zip",))
    for at_once in (25, 50_000):
        rows = listing.walked(spark, str(tmp_path), scope, at_once).collect()
        assert len({r.path for r in rows}) == len(rows)
        left = {r.path: r.reason for r in rows if r.reason}
        assert left == {"/node_modules": "dependency", "/Library/Caches": "library", "/Library/loose": "library", "/a.zip": "file type"}
        kept = {r.path for r in rows if not r.reason}
        assert kept == {"/wide", "/deep", "/P.app", "/link", "/Library", "/Library/Mobile Documents", "/Library/Mobile Documents/in", "/Library/Mobile Documents/in/z"} | {f"/wide/d{k}{x}" for k in range(300) for x in ("", "/f.txt")} | {"/deep" + "/n" * k for k in range(1, 31)}
    assert sum(r.size for r in rows if not r.is_link) == sum(range(300))


def test_filters_keep_the_scan_out(spark, tmp_path, monkeypatch):
    for p in ("a/b/c", "a/x", "z/y"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "f").write_text("")
    reader = listing._Pushed(str(tmp_path), 1, False)
    from pyspark.sql.datasource import EqualTo, Not, StringStartsWith

    given = [Not(StringStartsWith(("path",), "/a/b/")), StringStartsWith(("path",), "/a"), EqualTo(("name",), "f")]
    assert list(reader.pushFilters(given)) == given
    entered = []
    scan = listing._Reader._scan
    monkeypatch.setattr(listing._Reader, "_scan", lambda self, folder: entered.append(os.path.relpath(folder, tmp_path)) or scan(self, folder))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {*entered} == {".", "a", "a/x"} and {"/a", "/a/b", "/a/x", "/a/x/f"} <= {r[0] for r in rows}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = listing.listing(spark, str(tmp_path)).where("NOT startswith(path, '/a/b/') AND startswith(path, '/a')")
        assert sorted(r.path for r in some.collect()) == ["/a", "/a/b", "/a/x", "/a/x/f"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_the_users_library_is_noise(spark):
    rows = [(1, 0, "Users", True), (2, 1, "me", True), (3, 2, "Library", True), (4, 3, "x", True), (5, 4, "f", False), (6, 2, "docs", True), (7, 6, "g", False), (8, 0, "Library", True), (9, 8, "h", False)]
    built = catalog.build(spark.createDataFrame([(*r, 0, 0) for r in rows], "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long"))
    assert {r.entry_id for r in built.where("noise").collect()} == {4, 5, 9}


def test_retired_watchers_are_not_heard(spark, tmp_path):
    """Two batches: the highest epoch of the first one still counts in the second."""
    schema = "source string, epoch long, seq long, what string"
    first = [("s", 1, 1, "a"), ("s", 2, 2, "b"), ("s", 1, 3, "late"), ("t", 5, 4, "c")]
    second = [("s", 1, 5, "late"), ("s", 2, 6, "d"), ("s", 3, 7, "e"), ("t", 4, 8, "late"), ("u", 0, 9, "f"), ("s", 2, 10, "late")]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feed.of_living_streams(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.what for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert got == ["a", "b", "c", "d", "e", "f"]


def test_a_watchers_rows_are_not_held_together():
    """However many batches a source has, only a few are in memory; seq may pass 53 bits."""
    class State:
        exists, get = False, None

        def update(self, value):
            self.now = value

    met, most, base = [], [0], 2**60

    def parts():
        for k in range(50):
            rows = pd.DataFrame({"source": 0, "epoch": [k, k - 1, k, k - 1], "seq": [base + 4 * k + n for n in (0, -1, 1, 2)]})
            met.append(weakref.ref(rows))
            most[0] = max(most[0], sum(r() is not None for r in met))
            yield rows
            del rows

    state = State()
    got = pd.concat(list(feed._hearing()((0,), parts(), state)))
    assert sorted(got["seq"]) == sorted(base + 4 * k + n for k in range(50) for n in (-1, 0, 1)) and state.now == (49,) and most[0] <= 3
