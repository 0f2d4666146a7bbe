"""Catalog search: filter, score, order, top k; recent entries; narrowing; several sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans import language
from .catalog import _kept
from .subtrees import numbered

#: An empty line lists so many recent files.
RECENT = 200
#: Up to FULL results are put in order by one task, more in ranges.
FULL = 200_000
#: `bounded` puts so many in order unless told.
SORTED = 5000


@dataclass(frozen=True)
class Options:
    sort: str = "relevance"  # relevance, name, modified, size
    ascending: bool = False
    kind: int | None = None
    now: int = 0
    home: str = "/"
    root: str = "/"  # where the catalog's root stands; paths in a line may begin with it
    folder: str = "/"  # relative paths in a line begin here
    syllables: bool = True  # Han names are found by their syllables in Latin letters, too
    zone: str = "UTC"
    first_weekday: int = 0  # Monday


def understood(line: str, o: Options, is_path: Callable[[str], bool] | None = None) -> language.Search:
    return language.understand(line, o.now, is_path, zone=o.zone, first_weekday=o.first_weekday)


def found(catalog: DataFrame, line: str, o: Options) -> DataFrame:
    """Matching rows with their score (0 unless sorted by relevance).

    A line with blanks that is the path of an entry is looked for as a whole, which takes one filtered scan to tell.
    """

    def is_path(path: str) -> bool:
        path = o.home.rstrip("/") + path[1:] if path.startswith("~") else path
        path = path if path.startswith("/") else f"{o.folder.rstrip('/')}/{path}"
        path = path.removeprefix(o.root.rstrip("/")) if o.root != "/" else path
        return not catalog.where(F.col("rel_path") == (path.rstrip("/") or "/")).limit(1).isEmpty()

    search = understood(line, o, is_path)
    rows = catalog.where(language.predicate(search, o.home, o.root, o.syllables) & (F.col("entry_id") != 0))
    if "deleted" in catalog.columns:
        rows = rows.where("NOT deleted")
    if o.kind is not None:
        rows = rows.where(F.col("kind") == o.kind)
    return rows.withColumn("score", language.score(search, o.now, o.syllables) if o.sort == "relevance" else F.lit(0))


def order(o: Options) -> list[Column]:
    """Ties go by entry id upwards, in either direction."""
    key = {"relevance": F.col("score"), "name": names.natural_key(F.col("folded")), "modified": F.col("mtime"), "size": F.col("size")}[o.sort]
    return [key.asc() if o.ascending and o.sort != "relevance" else key.desc(), F.col("entry_id")]


def top(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first k rows of an order, with their rank from 1."""
    return rows.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def results(rows: DataFrame, by: list[Column], full: int = FULL, head: int | None = None) -> DataFrame:
    """All rows with rank (from 1), total and sorted_count (long).

    A caller that gives `head` has only so many of more than `full` rows ranked; the others' rank is null, and they follow by id.
    """
    n = rows.count()
    if n <= full:
        ranked, head = top(rows, by, n), n
    elif head is None:
        ranked, head = numbered(_kept(rows), by, 1, "rank").withColumn("rank", F.col("rank").cast("int")), n  # the ranges are sampled first
    else:
        ranked = bounded(rows, by, head).withColumnRenamed("place", "rank")
    return ranked.withColumns({"total": F.lit(n).cast("long"), "sorted_count": F.lit(head).cast("long")})


def search(catalog: DataFrame, line: str, o: Options, limit: int | None = None) -> DataFrame:
    """All results as `results` gives them, or the best `limit` with rank; an empty line lists recent files."""
    if not understood(line, o).clauses:
        return recent(catalog, o.kind)
    rows = found(catalog, line, o)
    return results(rows, order(o)) if limit is None else top(rows, order(o), limit)


def takes_topics(o: Options, alone: bool = False) -> bool:
    """Whether a search also looks at topics: without a kind of files, or where topics are asked for alone."""
    return alone or o.kind is None


def recent(catalog: DataFrame, kind: int | None = None, limit: int = RECENT) -> DataFrame:
    """Files of the user's area, last modified first."""
    rows = catalog.where("user_area AND NOT noise AND NOT in_package AND NOT hidden AND kind <> 1")
    rows = rows.where(F.col("kind") == kind) if kind is not None else rows
    return top(rows.withColumn("score", F.lit(0)), [F.desc("mtime"), F.col("entry_id")], limit)


def bounded(rows: DataFrame, by: list[Column], k: int = SORTED) -> DataFrame:
    """All rows with `place`: the best k by rank, the others null, to follow by source and entry id."""
    key = [c for c in ("source_ix", "entry_id") if c in rows.columns]
    head = top(rows, by, k).select(*key, F.col("rank").alias("place"))
    return rows.join(head, key, "left")


def can_narrow(before: str, after: str, now: int = 0) -> bool:
    """Whether the results of `before` hold those of `after`, so that they can be searched instead."""
    a, b = language.understand(before, now), language.understand(after, now)
    if not a.clauses or a.timed or b.timed or len(b.clauses) < len(a.clauses):
        return False

    def needle(c: list) -> str | None:
        return c[0].value if len(c) == 1 and c[0].kind == "name" and not c[0].negated and c[0].value else None

    pairs = [(needle(x), needle(y)) for x, y in zip(a.clauses, b.clauses, strict=False)]
    return all(x and y and x in y and (not x.isascii() or y.isascii()) for x, y in pairs)


def search_sources(sources: list[tuple[str, DataFrame]], line: str, o: Options, limit: int | None = None) -> DataFrame:
    """One order over several catalogs, of all results or the best `limit`: by the sort key, then by source, then by entry id."""
    rows, empty = None, not understood(line, o).clauses
    for i, (name, catalog) in enumerate(sources):
        if not empty:
            own, by = found(catalog, line, o), order(o)
        else:
            own = catalog.where("user_area AND NOT noise AND NOT in_package AND NOT hidden AND kind <> 1").withColumn("score", F.lit(0))
            by = [F.desc("mtime"), F.col("entry_id")]
        own = own.select("entry_id", "name", "folded", "score", "mtime", "size", F.lit(i).alias("source_ix"), F.lit(name).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    by = [by[0], F.col("source_ix"), by[1]]
    return results(rows, by) if limit is None and not empty else top(rows, by, limit or RECENT)


def supplemented(results: DataFrame, hits: DataFrame, catalog: DataFrame, version: int) -> DataFrame:
    """Results (entry_id, score) and further hits (entry_id, version, reason) that other searches found.

    Hits on unknown entries or of another version go; a hit on a result adds its reason; the others
    follow all results, last modified first.
    """
    fresh = hits.where((F.col("version").isNull()) | (F.col("version") == version)).groupBy("entry_id").agg(F.min("reason").alias("reason"))
    live = fresh.join(catalog.select("entry_id", "name", "mtime"), "entry_id")
    own = results.select("entry_id", "name", "mtime", "score").join(live.select("entry_id", "reason"), "entry_id", "left").withColumn("tier", F.lit(0))
    new = live.join(results.select("entry_id"), "entry_id", "left_anti").withColumns({"score": F.lit(0), "tier": F.lit(1)})
    return own.unionByName(new.select(own.columns))


def supplemented_sources(found_rows: DataFrame, hits: DataFrame, sources: list[tuple[str, DataFrame, int]], o: Options) -> DataFrame:
    """Results of several sources with further hits, in one order: (rank, source, entry_id, tier, reason, total, sorted_count).

    found_rows: as `search_sources` gives them. hits: source, entry_id, version, reason, nth. sources: name, catalog and the version that was
    searched. Hits of unknown sources, of another version of their own source and on entries that are not live go; of several
    on an entry the last one, by nth, tells the reason. By relevance hits that are no results follow all results, last
    modified first; in any other order all rows stand where they belong.
    """
    columns = ["source", "source_ix", "entry_id", "name", "folded", "score", "mtime", "size"]
    found_rows, live = _kept(found_rows.select(columns)), None  # read twice
    for k, (name, catalog, version) in enumerate(sources):
        catalog = catalog.where("NOT deleted") if "deleted" in catalog.columns else catalog
        own = hits.where((F.col("source") == name) & (F.col("version").isNull() | (F.col("version") == version)))
        own = own.groupBy("entry_id").agg(F.max_by("reason", "nth").alias("reason")).join(catalog.select("entry_id", "name", "folded", "mtime", "size"), "entry_id")
        own = own.withColumns({"source": F.lit(name), "source_ix": F.lit(k), "score": F.lit(0)})
        live = own if live is None else live.unionByName(own)
    key = ["source_ix", "entry_id"]
    rows = found_rows.join(live.select(*key, "reason"), key, "left").withColumn("tier", F.lit(0))
    more = live.join(found_rows.select(key), key, "left_anti").withColumn("tier", F.lit(1))
    both = _kept(rows.unionByName(more.select(rows.columns)))  # counted, then put in order
    if o.sort == "relevance":
        by = [F.col("tier"), F.desc("score"), F.when(F.col("tier") == 1, F.col("mtime")).desc()]
    else:
        by = [order(o)[0]]
    ranked = results(both, [*by, F.col("source_ix"), F.col("entry_id")])
    return ranked.select("rank", "source", "entry_id", "tier", "reason", "total", "sorted_count")


def merged_with_topics(files: DataFrame, topics: DataFrame, o: Options) -> DataFrame:
    """Files (entry_id, name, score, mtime, size) and topics (topic_id, title, score, modified) in one list.

    Sorted by (key, is_topic, id, item): files keep their order, ties by entry id; a topic stands before the first file it beats (higher score, later time);
    by size, topics come before files of any size when ascending, else last.
    """
    f = files.select(F.concat(F.lit("f:"), F.col("entry_id").cast("string")).alias("item"), F.col("entry_id").alias("id"), F.col("name").alias("title"), F.col("score").cast("double").alias("score"), F.col("mtime").cast("double").alias("at"), F.col("size").cast("double").alias("size"), F.lit(0).alias("is_topic"))
    t = topics.select(F.concat(F.lit("t:"), "topic_id").alias("item"), F.lit(None).cast("long").alias("id"), "title", F.col("score").cast("double").alias("score"), F.col("modified").cast("double").alias("at"), F.lit(0.0).alias("size"), F.lit(1).alias("is_topic"))
    key = {"relevance": "score", "modified": "at", "size": "size", "name": "title"}[o.sort]
    return f.unionByName(t).withColumn("key", F.col(key))
