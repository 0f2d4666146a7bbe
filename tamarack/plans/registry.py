"""Names of the catalog and topic queries. Their SQL twins are in `oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, present
from ..operators import catalog as cat
from ..operators import changes, coverage, replay, scope, search, topics, upkeep
from ..sources import sessions
from ..streaming import feed
from . import adapters as ad
from . import language, oracle
from .adapters import NOW

SHOWN = ("rank", "entry_id", "name", "score")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


TOTALS = ("total", "sorted_count")


def _search(line: str, columns: tuple = SHOWN, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search.search(ad.catalog(spark, sf_dir), line, search.Options(now=NOW, **options)).select(*columns, *(TOTALS if line else ()))


def _ids(line: str) -> Callable[[SparkSession, str], DataFrame]:
    """All matches of a line, unordered."""
    return lambda spark, sf_dir: search.found(ad.catalog(spark, sf_dir), line, search.Options(sort="name", now=NOW)).select("entry_id", "name")


#: Searches, by operator: matching sets, and ranked lists.
MATCHES = {
    "op_f1_name": "doc-1", "op_f2_case": "case:Doc-1", "op_f3_path": "path:src3/en", "op_f4_descendant": "src1/", "op_f6_glob": "*doc?2*.png",
    "op_f7_regex": r"regex:^my_doc\d+5\.", "op_f8_ext": "ext:md;txt", "op_f9_kind": "kind:image", "op_f10_files": "file:", "op_f10_folders": "folder:",
    "op_f11_file_or": "folder:en|file:doc-9", "op_f12_size": "size:>1.5mb", "op_f13_modified": "dm:2024-01-10..2024-01-20", "op_f14_not_ancestor": "doc !node_modules",
    "op_f15_not_path": "my_doc !path:src1/", "op_p3_and": "doc 7 ext:pdf", "op_p3_or": "png|swift size:<2mb", "op_p4_not": "doc !kind:video", "op_p9_size": "size:100kb..700kb",
    "op_p10_date": "dm:week", "op_p10_ago": "dm:3d", "op_p7_unknown_key": "foo:doc", "op_f21_scan": "my_doc1", "op_f23_filter": "kind:code size:>1mb", "op_m1_alternatives": "doc-1|doc-2|my_doc3",
    "op_p1_paste": "'file://host/src3%2Fen/'",
}
RANKED = {
    "op_r3_score": ("doc-1", {}), "op_r4_or_score": ("doc-1|my_doc2", {}), "op_r5_relevance": ("my", {}), "op_r6_natural_sort": ("doc", {"sort": "name", "ascending": True}),
    "op_r7_sort_size": ("doc", {"sort": "size"}), "op_r7_sort_modified": ("doc", {"sort": "modified", "ascending": True}), "op_r8_recent": ("", {}), "op_f17_option_kind": ("doc", {"kind": 4}),
}
QUERIES |= {k: _ids(v) for k, v in MATCHES.items()}
QUERIES |= {k: _search(v, **o) for k, (v, o) in RANKED.items()}


@query
def op_r1_quality(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir)
    return rows.select("entry_id", *[names.match_quality(F.col("name"), F.col("folded"), n).alias(f"q_{i}") for i, n in enumerate(("doc", "doc-1", "d", "1", "my_doc12"))])


@query
def op_r9_bounded(spark, sf_dir):
    o = search.Options(now=NOW)
    return search.bounded(search.found(ad.catalog(spark, sf_dir), "doc", o), search.order(o), 100).select("entry_id", "place")


@query
def op_f18_predicates(spark, sf_dir):
    """Several searches' atoms evaluated side by side on every entry."""
    tests = [language.predicate(language.understand(line, NOW)).alias(f"p{i}") for i, line in enumerate(("doc-1", "ext:pdf", "!path:en", "size:>1mb"))]
    return ad.catalog(spark, sf_dir).select("entry_id", *tests)


@query
def op_c1_narrow(spark, sf_dir):
    """`doc-1` then `doc-12`: the second search runs on the first one's results."""
    assert search.can_narrow("doc-1", "doc-12")
    first = search.found(ad.catalog(spark, sf_dir), "doc-1", search.Options(now=NOW))
    return search.found(first.drop("score"), "doc-12", search.Options(now=NOW)).select("entry_id", "score")


@query
def op_j1_paths(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", "rel_path", "depth")


@query
def op_j2_resolve(spark, sf_dir):
    """Paths of the change feed, as far as the catalog has them."""
    return cat.resolve(ad.catalog(spark, sf_dir), ad.seen(spark, sf_dir).select("path").distinct())


@query
def op_m7_parent_join(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir)
    return cat.children(rows, rows.where("is_dir").select("parent_id", F.upper("name").alias("name")))


@query
def op_s3_classify(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", "ext", "kind", "hidden", "noise", "in_package", "size")


@query
def op_a1_report(spark, sf_dir):
    return cat.report(ad.catalog(spark, sf_dir))


@query
def op_q1_validate(spark, sf_dir):
    return cat.validate(ad.entries(spark, sf_dir))


def _left_out(spark, sf_dir):
    return coverage.reasons(ad.catalog(spark, sf_dir), ["/src1/en", "/src2"], ["node_modules", "src5"], ["zip", "xyz"])


@query
def op_s5_exclusion(spark, sf_dir):
    return _left_out(spark, sf_dir).select("entry_id", "reason")


SCOPE = scope.Scope(user_paths=("/src1/en",), library="/src3", limited=True, system_roots=("/src2",), system="/src4", system_kept="/src4/de", dependencies=("node_modules", "src5"), extensions=("zip", "xyz"), always_paths=("/src6/fr",), always_names=("src8",))


@query
def op_s5_scope(spark, sf_dir):
    """All rules of a scan's scope over the catalog's paths, in their order."""
    rows = ad.catalog(spark, sf_dir)
    return rows.select("entry_id", F.coalesce(SCOPE.reason(F.col("rel_path"), F.col("is_dir")), F.lit("")).alias("reason"))


@query
def op_x11_epochs(spark, sf_dir):
    """The events as a stream of several watchers, each replaced after some thousand events: what retired ones still send is dropped."""
    folder = feed.working_folder(spark)
    events = spark.readStream.schema(ad.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    epoch = F.expr("event_id div 700 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END")
    rows = events.select((F.col("user_id") % 5).alias("source"), epoch.alias("epoch"), F.col("event_id").alias("seq"), "event_type")
    out = feed.of_living_streams(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query
def op_a2_coverage(spark, sf_dir):
    return coverage.counters(_left_out(spark, sf_dir))


@query
def op_a4_coverage_merge(spark, sf_dir):
    """Coverage of the catalog and of its files alone, added up."""
    rows = _left_out(spark, sf_dir).where("reason IS NOT NULL")
    one = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return coverage.merged(one.unionByName(rows.where("NOT is_dir").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))))


@query
def op_a3_scope_count(spark, sf_dir):
    rows = _left_out(spark, sf_dir)
    return rows.agg(F.count_if(F.col("reason").isin("hidden", "dependency", "package", "file type")).alias("n"))


@query
def op_a5_uncovered(spark, sf_dir):
    """Sources of documents that no conversation names as a root: here those with an odd number."""
    roots = ad.table(spark, sf_dir, "documents").select(F.col("source").alias("root")).distinct()
    return coverage.uncovered(roots, roots.where("CAST(substring(root, 4) AS INT) % 2 = 0"))


@query
def op_a12_counters(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir).withColumn("deleted", F.col("entry_id") % 3 == 0)
    return cat.needs_compaction(rows, 100)


@query
def op_x9_compact(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir).withColumn("deleted", F.col("entry_id") % 3 == 0)
    return cat.compacted(rows).select("entry_id", "new_id")


@query
def op_x6_sweep(spark, sf_dir):
    removed = ad.catalog(spark, sf_dir).where("entry_id IN (2, 1031) OR entry_id % 97 = 0").select(F.col("rel_path").alias("path"))
    return changes.swept(ad.catalog(spark, sf_dir), removed).select("entry_id", "deleted")


@query
def op_x4_outer_roots(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir).where("entry_id % 5 = 0 OR (is_dir AND entry_id % 3 = 0)")
    return changes.outer_roots(rows.select(F.col("rel_path").alias("path")))


@query
def op_x5_reconcile(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir)
    return changes.reconciled(rows, "/src3", rows.where("entry_id % 4 <> 0").select("rel_path")).select("entry_id", "rel_path")


@query
def op_x7_inherited(spark, sf_dir):
    """src4 renamed to node_modules and src9.app to plain: flags of all below follow."""
    rows = ad.catalog(spark, sf_dir)
    renamed = spark.createDataFrame([("src4", "node_modules"), ("src9.app", "plain")], "old string, new string")
    return cat.classified(changes.inherited(rows, renamed).select("entry_id", "parent_id", "name", "is_dir", "size", "mtime", "rel_path", "depth", "ancestors")).select("entry_id", "noise", "in_package")


@query
def op_a10_coalesce(spark, sf_dir):
    return changes.coalesced(ad.seen(spark, sf_dir))


def _latest(spark, sf_dir):
    rows = ad.seen(spark, sf_dir)
    last = rows.groupBy("path").agg(F.max_by(F.struct("present", "size", "mtime"), "event_id").alias("x"), F.max("event_id").alias("event_id"))
    return last.select("path", "event_id", "x.*")


@query
def op_x3_apply(spark, sf_dir):
    return changes.applied(ad.catalog(spark, sf_dir), _latest(spark, sf_dir), cursor=100).select("path", "op", "event_id")


@query
def op_a9_summary(spark, sf_dir):
    return changes.summary(changes.applied(ad.catalog(spark, sf_dir), _latest(spark, sf_dir)))


@query
def op_x8_upsert(spark, sf_dir):
    return changes.upserted(ad.catalog(spark, sf_dir).where("NOT is_dir"), _latest(spark, sf_dir))


@query
def op_x8_upkeep(spark, sf_dir):
    """The whole catalog after the change feed: parents that it lacks, new ids, some files that are folders now, some paths left out."""
    seen = _latest(spark, sf_dir).withColumn("is_dir", F.col("event_id") % 50 == 0)
    after = upkeep.upkept(ad.catalog(spark, sf_dir), seen, None, ["/src5"], ["src6"], ["zip"])
    return after.select("entry_id", "parent_id", "name", "is_dir", "size", "mtime", "rel_path", "depth", F.array_join("ancestors", "/").alias("ancestors"))


@query
def op_m2_multi(spark, sf_dir):
    both = [("docs", ad.catalog(spark, sf_dir)), ("parts", ad.parts(spark, sf_dir))]
    return search.search_sources(both, "1 ext:log|txt", search.Options(now=NOW)).select("rank", "source", "entry_id", "score")


@query
def op_m2_multi_recent(spark, sf_dir):
    both = [("docs", ad.catalog(spark, sf_dir)), ("parts", ad.parts(spark, sf_dir))]
    return search.search_sources(both, "", search.Options(now=NOW)).select("rank", "source", "entry_id")


@query
def op_m3_supplement(spark, sf_dir):
    """Results of a search and hits that the change feed gives for the same files, some of an old version."""
    rows = ad.catalog(spark, sf_dir)
    results = search.found(rows, "doc-1", search.Options(now=NOW))
    hits = ad.table(spark, sf_dir, "events").select((F.lit(100000) + F.col("user_id")).alias("entry_id"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("version"), F.col("event_type").alias("reason"))
    return search.supplemented(results, hits, rows, 2).select("entry_id", "tier", "reason", "score")


@query
def op_m4_additional(spark, sf_dir):
    o = search.Options(now=NOW)
    files = search.found(ad.catalog(spark, sf_dir), "doc-1", o)
    found = topics.relevance(ad.topics(spark, sf_dir)[0], "the", NOW, normalize=False)
    both = search.merged_with_topics(files, found, o)
    return search.top(both, [F.desc("key"), F.col("is_topic"), F.col("id"), F.col("item")], both.count()).select("rank", "item", "key")


@query
def op_m6_provider_scope(spark, sf_dir):
    return ad.topics(spark, sf_dir)[0].where(F.col("provider").isin("north", "south")).select("topic_id", "provider")


@query
def op_t1_fold(spark, sf_dir):
    _, messages = ad.topics(spark, sf_dir)
    return messages.select("topic_id", "msg_key", topics.fold(F.col("body")).alias("f"))


@query
def op_t3_literal_and(spark, sf_dir):
    return topics.matching(ad.topics(spark, sf_dir)[1], "the ING")


@query
def op_m8_term_semijoin(spark, sf_dir):
    """Two terms as two semi-joins on messages."""
    heads, messages = ad.topics(spark, sf_dir)
    f = messages.select("topic_id", topics.fold(F.col("body")).alias("f"))
    for term in topics.terms("tion que"):
        heads = heads.join(f.where(F.col("f").contains(term)), "topic_id", "left_semi")
    return heads.select("topic_id")


@query
def op_t4_postings(spark, sf_dir):
    """How many topics each gram of the postings has."""
    return topics.postings(ad.topics(spark, sf_dir)[1]).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query
def op_t5_candidates(spark, sf_dir):
    """Topics with every gram of a query, and whether they match it."""
    _, messages = ad.topics(spark, sf_dir)
    some = topics.candidates(topics.postings(messages), "ouer éeau")
    hit = topics.matching(messages, "ouer éeau").withColumn("hit", F.lit(True))
    return some.join(hit, "topic_id", "left").select("topic_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query
def op_t6_topics(spark, sf_dir):
    heads, messages = ad.topics(spark, sf_dir)
    return topics.search(heads, messages, "de", ["north", "west"], 20).select("topic_id", "modified", "has_more")


@query
def op_t7_excerpt(spark, sf_dir):
    return topics.excerpts(ad.topics(spark, sf_dir)[1], "tion")


@query
def op_t8_relevance(spark, sf_dir):
    return topics.relevance(ad.topics(spark, sf_dir)[0], "the in", NOW).select("topic_id", "score")


@query
def op_a7_topic_count(spark, sf_dir):
    return ad.topics(spark, sf_dir)[0].where("NOT archived AND provider IN ('north', 'south')").agg(F.count(F.lit(1)).alias("n"))


@query
def op_a8_thread_summary(spark, sf_dir):
    return topics.thread_summary(ad.topics(spark, sf_dir)[1])


@query
def op_t12_titles(spark, sf_dir):
    return ad.topics(spark, sf_dir)[0].select("topic_id", "title", "provider", "modified", "archived", "messages")


@query
def op_k3_topic_upsert(spark, sf_dir):
    """Every third topic retitled, some moved to another provider, some archived, every fifth unknown before."""
    heads, _ = ad.topics(spark, sf_dir)
    k = F.col("topic_id").cast("int")
    new = heads.select(
        "topic_id", F.when(F.col("modified") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("provider")).alias("provider"), "modified", ((k % 13 == 0) | F.col("archived")).alias("archived"),
    )
    return topics.upserted(heads.where(k % 5 != 0), new)


@query
def op_k3_title_messages(spark, sf_dir):
    """Titles and projects (here the provider) as messages."""
    return topics.title_messages(ad.topics(spark, sf_dir)[0].withColumn("project", F.col("provider")))


@query
def op_a5_summary(spark, sf_dir):
    """How many document sources are not among the indexed ones, and the first of them."""
    roots = ad.table(spark, sf_dir, "documents").select(F.col("source").alias("root"))
    return coverage.uncovered_summary(roots, roots.where("CAST(substring(root, 4) AS INT) % 2 = 0").distinct())


def _hits_of_two(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    source = F.element_at(F.array(F.lit("docs"), F.lit("parts"), F.lit("gone")), (F.col("event_id") % 3 + 1).cast("int"))
    entry = F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 100000).otherwise(F.col("user_id") + 10)
    return e.select(source.alias("source"), entry.alias("entry_id"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4).alias("version"), F.col("event_type").alias("reason"), F.col("event_id").alias("nth"))


def _supplemented(spark, sf_dir, **options):
    docs, parts, o = ad.catalog(spark, sf_dir), ad.parts(spark, sf_dir), search.Options(now=NOW, **options)
    rows = search.search_sources([("docs", docs), ("parts", parts)], "1 ext:log|txt", o)
    return search.supplemented_sources(rows, _hits_of_two(spark, sf_dir), [("docs", docs, 2), ("parts", parts, 3)], o)


@query
def op_m3_sources(spark, sf_dir):
    """Two sources of versions 2 and 3, and hits of several versions on both; results by relevance stay ahead."""
    return _supplemented(spark, sf_dir)


@query
def op_m3_by_size(spark, sf_dir):
    return _supplemented(spark, sf_dir, sort="size", ascending=True)


@query
def op_k4_message_changes(spark, sf_dir):
    _, messages = ad.topics(spark, sf_dir)
    cut = F.when(F.col("msg_key") % 3 == 0, F.lit("")).when(F.col("msg_key") % 3 == 1, F.concat("body", F.lit("."))).otherwise(F.col("body"))
    return topics.message_changes(messages.where("msg_key % 4 <> 2"), messages.select("topic_id", "msg_key", cut.alias("body")))


@query
def op_m9_reconcile(spark, sf_dir):
    _, messages = ad.topics(spark, sf_dir)
    return topics.vanished(messages, messages.where("msg_key % 2 = 0").select("topic_id", "msg_key")).select("topic_id", "msg_key")


@query
def op_x15_archive(spark, sf_dir):
    """Archive flags that differ from the source's, which archives every fourth topic."""
    heads, _ = ad.topics(spark, sf_dir)
    return heads.withColumn("now", F.col("topic_id").cast("int") % 4 == 0).where("archived <> now").select("topic_id", "now")


@query
def op_s10_latest(spark, sf_dir):
    """The newest document of each source and language, ties by the larger id."""
    d = ad.table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.max_by("doc_id", F.struct(F.col("doc_id") % 40, "doc_id")).alias("doc_id"))


@query
def op_s12_changed_threads(spark, sf_dir):
    """Threads whose (count, last) differs from what was read before: here every thread once had a turn less."""
    now = topics.thread_summary(ad.topics(spark, sf_dir)[1])
    before = now.select("topic_id", F.when(F.col("topic_id").cast("int") % 2 == 0, F.col("items") - 1).otherwise(F.col("items")).alias("items"), "last")
    return now.join(before, ["topic_id", "items", "last"], "left_anti")


@query
def op_e6_size_codec(spark, sf_dir):
    d = ad.table(spark, sf_dir, "lineitem")
    big = (F.col("l_extendedprice") * 100_000).cast("long")
    return d.select("l_orderkey", "l_linenumber", names.decoded_size(big).alias("kept"))


@query
def op_e10_highlight(spark, sf_dir):
    spans = present.highlights(F.col("folded"), ["doc", "oc", "1"])
    return ad.catalog(spark, sf_dir).select("entry_id", F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("spans"))


@query
def op_e10_line(spark, sf_dir):
    """Highlights of a line's words and of its globs' literal parts, in UTF-16 units, over names with a character above U+FFFF before them."""
    needles = language.literals(language.understand("*doc?2* case:Y !en file:7 size:>1 folder:x|1", NOW))
    shown = F.concat(F.lit("\U0001F600"), F.col("name"))
    spans = present.in_utf16(shown, present.highlights(F.lower(shown), needles))
    return ad.catalog(spark, sf_dir).select("entry_id", F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("spans"))


@query
def op_e11_abbreviate(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", present.abbreviated(F.col("rel_path"), "/src2/en").alias("shown"))


@query
def op_e12_date_text(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", present.date_text(F.col("mtime"), NOW).alias("shown"))


@query
def op_e13_count_text(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", present.count_text(F.col("size")).alias("shown"))


@query
def op_e13_size_text(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("entry_id", present.size_text(F.col("size")).alias("shown"))


@query
def op_e7_alternate_keys(spark, sf_dir):
    """Alternate keys of whole texts of documents, taken as names."""
    d = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"), names.syllable_table(spark).alias("table"))
    return d.select("doc_id", F.array_join(names.alternate_keys(F.col("name"), F.col("table")), ",").alias("keys"))


@query
def op_e7_syllables(spark, sf_dir):
    """Syllables and initials of names that begin with Han characters."""
    return ad.han(spark, sf_dir).where("NOT is_dir").select("entry_id", F.col("alt_keys")[0].alias("full"), F.col("alt_keys")[1].alias("initials"))


@query
def op_f1_syllables(spark, sf_dir):
    """`wd` finds names by the initials of their syllables, `wend` by the syllables."""
    rows, o = ad.han(spark, sf_dir), search.Options(sort="name", now=NOW)
    one = search.found(rows, "wd", o).select("entry_id", F.lit("wd").alias("line"))
    return one.unionByName(search.found(rows, "wend", o).select("entry_id", F.lit("wend").alias("line")))


@query
def op_f1_no_syllables(spark, sf_dir):
    """Without syllables only characters count: those of the name, and its lower case for needles beyond ASCII."""
    rows, o = ad.han(spark, sf_dir), search.Options(sort="name", now=NOW, syllables=False)
    return search.found(rows, "文档|wd", o).select("entry_id", "name")


@query
def op_r2_alternate_points(spark, sf_dir):
    return search.found(ad.han(spark, sf_dir), "wd", search.Options(now=NOW)).select("entry_id", "score")


@query
def op_p11_kinds(spark, sf_dir):
    """How many entries each kind word finds; a word that is none is left out of the line."""
    words = ("folder", "app", "doc", "image", "video", "audio", "code", "archive", "document")
    tests = {w: language.predicate(language.understand(f"kind:{w} !kind:zzz", NOW)) for w in words}
    counts = ad.catalog(spark, sf_dir).agg(*[F.count_if(t).alias(w) for w, t in tests.items()])
    return counts.unpivot([], list(words), "word", "n")


@query
def op_p10_zone(spark, sf_dir):
    """Days, weeks from Sunday and months of other time zones, also where clocks are changed."""
    now = NOW + 60 * 86_400  # 2024-04-01
    lines = {"today": "dm:today", "yesterday": "dm:yesterday", "week": "dm:week", "month": "dm:month", "day": "dm:2024-01-15", "span": "dm:2024-01-10..2024-01-12", "after": "dm:>2024-02-03", "before": "dm:<2024-01-05"}
    zones = (("America/New_York", 6), ("Asia/Kolkata", 0), ("Europe/Berlin", 0))
    tests = {f"{k} {z}": language.predicate(language.understand(line, now if k in ("today", "yesterday", "week", "month") else NOW, zone=z, first_weekday=w)) for k, line in lines.items() for z, w in zones}
    rows = ad.table(spark, sf_dir, "events").select((F.lit(1704067200) + F.col("event_id") * 997 % (100 * 86_400)).alias("mtime"))
    counts = rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return counts.unpivot([], list(tests), "what", "n")


@query
def op_f7_budget(spark, sf_dir):
    """A pattern with choices inside a repeat, and its negation, by the engine that keeps to a budget."""
    rows, o = ad.catalog(spark, sf_dir), search.Options(sort="name", now=NOW)
    line = r'"regex:^(?:[a-z]+_|[a-z]+[0-9])+[0-9]*\.(?:md|TXT)$"'
    one = search.found(rows, line, o).select("entry_id", F.lit(True).alias("hit"))
    return one.unionByName(search.found(rows, "!" + line, o).select("entry_id", F.lit(False).alias("hit")))


@query
def op_a13_totals(spark, sf_dir):
    """Live entries of each source and of all, as a footer shows them."""
    both = ad.catalog(spark, sf_dir).select(F.lit("docs").alias("source")).unionByName(ad.parts(spark, sf_dir).select(F.lit("parts").alias("source")))
    return both.rollup("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")


@query
def op_e15_extensions(spark, sf_dir):
    """Types, brands and names of parts, taken as lists of extensions."""
    text = F.concat(F.lit(".."), "p_type", F.lit(", ."), "p_brand", F.lit(" "), "p_name", F.lit(","), "p_type")
    return ad.table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.listed_extensions(text), ";").alias("exts"))


@query
def op_e16_versions(spark, sf_dir):
    """Parts whose version (from size and price) is below 20.5."""
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-rc"))
    below = names.version_key(version) < F.array(F.lit(20), F.lit(5))
    return ad.table(spark, sf_dir, "part").select("p_partkey", below.alias("below"))


@query
def op_t14_resume(spark, sf_dir):
    """A command line for each topic, its title quoted."""
    heads, _ = ad.topics(spark, sf_dir)
    return heads.select("topic_id", F.concat(F.lit("open "), names.shell_quoted(F.concat("title", F.lit(" it's"))), F.lit(" --id "), "topic_id").alias("command"))


@query
def op_t9_branch(spark, sf_dir):
    """Turns on the branch of each conversation's last turn; every third turn goes back two turns."""
    c = ad.table(spark, sf_dir, "conversations")
    parent = F.when((F.col("turn") >= 2) & (F.col("turn") % 3 == 2), F.col("turn") - 2).when(F.col("turn") >= 1, F.col("turn") - 1)
    rows = c.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("id"), parent.cast("string").alias("parent"), F.col("turn").alias("ord"))
    return topics.active_branch(rows).select("conv", "ord")


@query
def op_t9_replay(spark, sf_dir):
    """Conversations as transcripts with branches, notes between agents, notices of filters and of forks: the records on show."""
    c = ad.table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    fork, note, m = (F.col("conv_id") % 3 == 2) & (turn == 3), turn % 7 == 6, lambda t: F.concat(F.lit("m"), t.cast("string"))
    parent = F.when(fork, m(F.lit(0))).when(note, None).when(turn % 5 == 4, m(turn - 2)).when(turn >= 1, m(turn - 1))
    filtered = F.when((F.col("conv_id") % 3 == 0) & (turn % 4 == 3), F.struct(F.lit(True).alias("contentFilterNotice")))
    said = F.when(note, F.concat(F.lit('<teammate-message from="w">'), "text", F.lit("</teammate-message>"))).otherwise(F.col("text"))
    value = F.struct(F.when(fork, replay.FORK).otherwise("message").alias("type"), m(turn).alias("id"), parent.alias("parentId"), "role", said.alias("content"), filtered.alias("providerData"))
    lines = c.select(F.col("conv_id").cast("string").alias("conv"), turn.cast("long").alias("ord"), F.to_json(value).alias("value"))
    return replay.active(replay.records(lines))


@query
def op_t10_visible_text(spark, sf_dir):
    """What conversations show, as transcripts in which clients wrapped, cut up or wrote some of the words."""
    c = ad.table(spark, sf_dir, "conversations")
    k, text = F.col("turn") % 9, F.coalesce("text", F.lit(""))
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    wrapped = F.concat(F.lit("<system-reminder data-role=\"x\">no\nno</system-reminder>\n<user_query>"), text, F.lit("</user_query> <image_local_path>/p</image_local_path>"))
    said = F.when(k == 1, wrapped).when(k == 2, F.concat(F.lit("<system-reminder data-role='compact-summary'>"), text)).when(k == 3, F.concat(F.lit(" <conversation_history_summary>"), text))
    said = said.when(k == 4, F.concat(F.lit("<Teammate-Message a>"), text, F.lit("</teammate-message>"))).when(k == 5, F.concat(F.lit("Please summarize the\nconversation above "), text, F.lit("<cb_summary>"))).otherwise(text)
    blocks = F.array(block("input_text", text), block("reasoning", F.lit("hidden")), block("output_text", F.lit("[{")))
    head = [F.when(k == 8, "note").otherwise("message").alias("type"), F.col("role")]
    one = F.to_json(F.struct(*head, said.alias("content"), F.when(k == 7, F.struct(F.lit(True).alias("isMeta"))).alias("providerData")))
    line = F.when(k == 6, F.to_json(F.struct(*head, blocks.alias("content")))).otherwise(one)
    return c.withColumn("value", line).select("conv_id", "turn", replay.visible_text().alias("shown"))


@query
def op_e18_explain(spark, sf_dir):
    """Why paths are or are not in the index: every entry's, and as many that no scan has met."""
    judged = _left_out(spark, sf_dir).withColumns({"no_access": F.col("entry_id") % 101 == 0, "cloud": F.col("entry_id") % 103 == 0})
    paths = judged.select(F.col("rel_path").alias("path"))
    more = paths.select(F.concat(F.lit("/Volumes/disk"), "path").alias("path")).unionByName(paths.select(F.concat("path", F.lit("/new")).alias("path")))
    return coverage.explained(paths.unionByName(more), judged, ["/src1/en", "/src2"])


@query
def op_x1_stream(spark, sf_dir):
    """The change feed applied to the catalog as a stream: the files it leaves."""
    folder = feed.working_folder(spark)
    feed.start_with(ad.catalog(spark, sf_dir).where("NOT is_dir"), folder)
    events = spark.readStream.schema(ad.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, so that a single file will do
    feed.follow(spark.sql(ad.SEEN_SQL, events=events), folder, f"{folder}/progress").awaitTermination()
    return feed.current(spark, folder)


@query
def op_p5_whole_path(spark, sf_dir):
    """A quoted path with blanks, that of the first part by name, as a search line."""
    rows = ad.parts(spark, sf_dir)
    line = rows.where("NOT is_dir").agg(F.min("rel_path")).first()[0]
    return search.found(rows, f"'{line}'", search.Options(sort="name", now=NOW)).select("entry_id", "name")


@query
def op_s6_loose_files(spark, sf_dir):
    return ad.catalog(spark, sf_dir).where(coverage.loose_file(["/src3/en", "/src4/de/"])).select("entry_id", "rel_path")


@query
def op_s8_not_entered(spark, sf_dir):
    """What a scan meets when every seventh folder is a placeholder."""
    rows = ad.catalog(spark, sf_dir).withColumn("cloud", F.col("is_dir") & (F.col("entry_id") % 7 == 0))
    return coverage.entered(rows).select("entry_id", "rel_path")


@query
def op_s9_descriptors(spark, sf_dir):
    """Conversations as descriptor files; some have no title, and every second was known before."""
    heads = ad.topics(spark, sf_dir)[0].withColumn("id", F.col("topic_id").cast("int"))
    fields = {
        "sessionId": F.concat(F.lit("d"), "topic_id"), "cliSessionId": F.when(F.col("id") % 3 != 0, F.col("topic_id")), "title": F.when(F.col("id") % 4 != 0, F.col("title")),
        "cwd": F.concat(F.lit("/p/"), "provider"), "lastActivityAt": F.when(F.col("id") % 5 != 0, F.col("modified") * 1000), "createdAt": F.lit("2024-01-05T00:00:00Z"), "isArchived": F.col("archived"),
    }
    files = heads.select(F.concat(F.lit("/d/"), "topic_id", F.lit(".json")).alias("file"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))
    known = heads.where("id % 2 = 0").select("topic_id", F.concat(F.lit("old "), "topic_id").alias("title"), F.lit("/old").alias("project"), F.lit("said").alias("excerpt"))
    return sessions.descriptors(files, known).select("topic_id", "desktop_id", "title", "project", F.col("modified").cast("long").alias("modified"), "archived", "excerpt")


@query
def op_s11_threads(spark, sf_dir):
    """Conversations as a thread table without a rollout_path; every fifth is a helper's."""
    heads = ad.topics(spark, sf_dir)[0].withColumn("id", F.col("topic_id").cast("int"))
    rows = heads.select(
        F.col("topic_id").alias("id"), "title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("named\n"), "topic_id")).otherwise(F.lit("")).alias("name"), F.when(F.col("id") % 2 == 0, F.lit("/p")).alias("cwd"),
        F.when(F.col("id") % 4 != 0, F.col("modified") * 1000).alias("updated_at_ms"), F.lit(7).alias("updated_at"), F.col("archived").cast("int").alias("archived"),
        F.when(F.col("id") % 5 == 0, F.lit("subagent")).otherwise(F.lit("user")).alias("thread_source"), F.when(F.col("id") % 7 == 0, F.lit("x-guardian")).alias("source"),
    )
    return sessions.threads(rows).select("topic_id", "title", "project", F.col("modified").cast("long").alias("modified"), "archived", "excerpt", "transcript")


@query
def op_s13_headers(spark, sf_dir):
    """First lines of two files for each conversation; metadata know every second topic, and every seventh's text came from elsewhere."""
    heads = ad.topics(spark, sf_dir)[0].withColumn("id", F.col("topic_id").cast("int"))
    two = heads.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    source = F.when(F.col("id") % 5 == 0, F.struct(F.lit("x").alias("subagent")))
    payload = F.struct(F.col("topic_id").alias("id"), F.lit("/cwd").alias("cwd"), source.alias("source"))
    kind = F.when(F.col("id") % 11 == 0, F.lit("other")).otherwise(F.lit("session_meta"))
    lines = two.select(F.concat_ws("/", F.lit("/archived_sessions"), "k", "topic_id").alias("file"), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("value"), (F.col("modified") + F.col("k") * (F.col("id") % 3 - 1)).cast("double").alias("changed"))
    known = heads.where("id % 2 = 0").select("topic_id", F.concat(F.lit("/p/"), "provider").alias("project"), "archived")
    return sessions.headers(lines, known, heads.where("id % 7 = 0")).select("topic_id", "project", F.col("modified").cast("long").alias("modified"), "archived", "transcript")


@query
def op_s14_sessions(spark, sf_dir):
    """Conversations as sessions of several users; the snapshot names u1."""
    heads = ad.topics(spark, sf_dir)[0].withColumn("id", F.col("topic_id").cast("int"))
    user = F.element_at(F.array(F.lit("u1"), F.lit("u2"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    settings = F.when(F.col("id") % 5 == 0, F.lit('{"conversationTags": {"wbQuickAsk": "1"}}')).when(F.col("id") % 7 == 0, F.lit("{broken")).otherwise(F.lit('{"a": [1]}'))
    rows = heads.select(
        F.col("topic_id").alias("id"), F.lit("/p").alias("cwd"), user.alias("user_id"), "title", F.when(F.col("id") % 2 == 0, F.lit("own\ntitle")).alias("custom_title"), F.when(F.col("archived"), F.lit("Archived")).alias("status"),
        (F.col("modified") * 1000).alias("created_at"), F.lit(0).cast("long").alias("updated_at"), ((F.col("modified") + 5) * 1000 * (F.col("id") % 2)).alias("last_activity_at"), F.when(F.col("id") % 13 == 0, F.lit(1)).alias("deleted_at"), settings.alias("session_settings"),
    )
    snapshot = f'{{"primary": {{"version": 1, "uid": "u1", "nickname": "n", "type": "t", "savedAt": {NOW * 1000 - 1}}}}}'
    account = sessions.account(spark.createDataFrame([(snapshot,)], "value string"), NOW)
    return sessions.sessions(rows, account, heads.where("id % 17 = 0")).select("topic_id", "title", "project", F.col("modified").cast("long").alias("modified"), "archived")


@query
def op_x2_lost(spark, sf_dir):
    """Changes by thousands: how many, and whether they tell of lost ones; here one path counts as the root."""
    flags = F.col("flags") + F.when(F.col("event_id") % 3000 == 0, changes.IDS_WRAPPED).otherwise(0)
    rows = ad.seen(spark, sf_dir).withColumn("flags", flags)
    return rows.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(changes.lost("/src5/en/my_doc5.TXT")).alias("lost"))


@query
def op_x4_merge(spark, sf_dir):
    """Two folders, one in the other, read again: every third file is gone, the others have grown."""
    rows = ad.catalog(spark, sf_dir).where("NOT is_dir")
    roots = spark.createDataFrame([("/src3",), ("/src3/en",), ("/src6/de",)], "path string")
    listed = rows.where("(startswith(rel_path, '/src3/') OR startswith(rel_path, '/src6/de/')) AND entry_id % 3 <> 0").withColumn("size", F.col("size") + 1)
    return changes.merged(rows, roots, listed)


@query
def op_x10_gap(spark, sf_dir):
    """A stream whose first events tell of lost ones: all is stored, and applied to a new listing of every second file."""
    folder = feed.working_folder(spark)
    files = ad.catalog(spark, sf_dir).where("NOT is_dir")
    feed.start_with(files, folder)
    events = spark.readStream.schema(ad.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = spark.sql(ad.SEEN_SQL, events=events).withColumn("flags", F.lit(changes.IDS_WRAPPED))
    feed.follow(rows, folder, f"{folder}/progress").awaitTermination()
    feed.rescanned(files.where("entry_id % 2 = 0"), folder, feed.pointer(spark, folder).batch)
    return feed.current(spark, folder)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked search: plain word, extension, excluded folder."""
    return _search("doc-1 ext:md;txt !src3")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
