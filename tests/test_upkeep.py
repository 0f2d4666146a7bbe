"""Paths, sweeps, change feeds as streams, listings and transcripts."""

import json
import time

from pyspark.sql import functions as F

from tamarack.operators import catalog, changes, coverage, search, topics
from tamarack.sources import listing, transcripts
from tamarack.streaming import feed


def test_listing_becomes_a_catalog(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/deep/leaf.txt").write_text("x" * 1234)
    (tmp_path / "README.md").write_text("hello")
    (tmp_path / "alias").symlink_to(tmp_path / "src")
    for depth in (1, 2):
        found = listing.listing(spark, str(tmp_path), depth)
        assert {(r.path, r.is_dir, r.is_link) for r in found.collect()} == {("/src", True, False), ("/src/deep", True, False), ("/src/deep/leaf.txt", False, False), ("/README.md", False, False), ("/alias", False, True)}
    built = catalog.build(listing.as_entries(found))
    assert {(r.rel_path, r.depth, r.size) for r in built.where("ext = 'txt'").collect()} == {("/src/deep/leaf.txt", 3, 1234)}


def test_streamed_changes_equal_one_batch(spark, tmp_path):
    start = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2), ("/c", 3, 3)], "rel_path string, size long, mtime long")
    events = [("/a", 0, 0, True, 9, 9), ("/b", 1, 0, False, 0, 0), ("/d", 2, 0, True, 4, 4), ("/a", 3, 0, True, 10, 10), ("/d", 4, 0, False, 0, 0), ("/b", 5, 0, True, 7, 7)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame(events[2 * i : 2 * i + 2], feed.CHANGE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    feed.start_with(start, str(tmp_path / "cat"))
    source = lambda: spark.readStream.schema(feed.CHANGE).option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    feed.follow(source(), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination()
    want = {("/a", 10, 10), ("/b", 7, 7), ("/c", 3, 3)}
    assert {tuple(r) for r in feed.current(spark, str(tmp_path / "cat")).collect()} == want
    feed.follow(source(), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination()  # nothing new
    done = feed.pointer(spark, str(tmp_path / "cat"))
    feed.apply_batch(spark.createDataFrame([("/a", 1, 0, False, 0, 0)], feed.CHANGE), done[0], str(tmp_path / "cat"))  # replayed
    assert {tuple(r) for r in feed.current(spark, str(tmp_path / "cat")).collect()} == want


def test_compaction_keeps_order(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 13).alias("entry_id"), (F.col("id") % 2 == 0).alias("deleted"))
    got = catalog.compacted(df).orderBy("new_id").collect()
    assert [r.new_id for r in got] == list(range(1, len(got) + 1))
    assert [r.entry_id for r in got] == sorted(r.entry_id for r in got)


def test_outer_roots(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/e",), ("/c/d/e/f/g",)], "path string")
    assert {r.path for r in changes.outer_roots(df).collect()} == {"/a", "/ab", "/c/d/e"}


def test_active_branch(spark):
    rows = [("x", "1", None, 1), ("x", "2", "1", 2), ("x", "3", "1", 3), ("x", "4", "3", 4), ("y", "1", None, 1), ("y", "2", "1", 2)]
    got = topics.active_branch(spark.createDataFrame(rows, "conv string, id string, parent string, ord long")).collect()
    assert {(r.conv, r.id) for r in got} == {("x", "1"), ("x", "3"), ("x", "4"), ("y", "1"), ("y", "2")}


def test_transcripts(spark, tmp_path):
    lines = [{"type": "user", "cwd": "/p", "message": {"content": "Hello\nthere"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "b"}]}}, {"type": "user", "isMeta": True, "message": {"content": "meta"}}]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/t1.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"type": "user", "mess')
    got = {(r.topic_id, r.body) for r in transcripts.read(spark, str(tmp_path)).collect()}
    assert got == {("t1", "Hello\nthere"), ("t1", "a\nb")}
    q = transcripts.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("told").count() == 2


def test_times(spark):
    df = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("x",)], "v string")
    assert [r.s for r in df.select(topics.seconds(F.col("v")).alias("s")).collect()] == [1704067200.0] * 3 + [None]


def test_topics_literal(spark):
    messages = spark.createDataFrame([("1", 0, "aba x bab"), ("2", 0, "ab"), ("2", 1, "c 50%_"), ("3", 0, "éAU"), ("3", 1, None)], "topic_id string, msg_key long, body string")
    hit = lambda q: {r.topic_id for r in topics.matching(messages, q).collect()}
    assert hit("abab") == set() and hit("abc") == set() and hit("ab c") == {"2"} and hit("%_") == {"2"} and hit("Éau") == {"3"}
    index = topics.postings(messages)
    for q in ("ab c", "éau", "aba"):
        assert hit(q) <= {r.topic_id for r in topics.candidates(index, q).collect()}


def test_grams_of_long_texts(spark):
    """Right for characters of all widths, and a text of 200,000 characters takes no square of that."""
    texts = ["", None, "a", "ab", "é", "a\U0001F600bc", "abcabc", "ab\ncé"]
    cut = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if n < 3 or t[i : i + n].isascii()}
    messages = spark.createDataFrame([(str(k), 0, t) for k, t in enumerate(texts)], "topic_id string, msg_key long, body string")
    got = sorted((r.topic_id, r.gram) for r in topics.postings(messages).collect())
    assert got == sorted((str(k), g) for k, t in enumerate(texts) for g in cut(t or ""))
    long = spark.range(1).select(F.lit("x").alias("topic_id"), F.lit(0).alias("msg_key"), F.repeat(F.lit("abcdé"), 40_000).alias("body"))
    began = time.perf_counter()
    assert topics.postings(long).count() == len(cut("abcdé" * 3))
    assert [r.topic_id for r in topics.candidates(topics.postings(long), "bcd dé").collect()] == ["x"]
    assert time.perf_counter() - began < 15


def test_grams_are_computed_once(spark):
    messages = spark.createDataFrame([("1", 0, "abc"), ("2", 0, "")], "topic_id string, msg_key long, body string")
    index = topics.postings(messages)
    assert index._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
    assert sorted(map(tuple, index.collect())) == [("1", g) for g in ("a", "ab", "abc", "b", "bc", "c")]


def test_bounded_keeps_all(spark):
    df = spark.range(100).select(F.col("id").alias("entry_id"), (F.col("id") % 7).alias("score"))
    got = search.bounded(df, [F.desc("score"), F.col("entry_id")], 10).collect()
    assert len(got) == 100 and sorted(r.place for r in got if r.place) == list(range(1, 11))


def test_deep_folders_and_long_package_names(spark):
    rows = [(k + 1, k, f"d{k}", True, 0, 0) for k in range(80)] + [(500, 80, "leaf.txt", False, 5, 5), (600, 0, "Foo.FrameWork", True, 0, 0), (601, 600, "in.txt", False, 1, 1), (602, 0, ".app", True, 0, 0), (603, 0, "framework", True, 0, 0)]
    built = catalog.build(spark.createDataFrame(rows, "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long"))
    got = {r.entry_id: r for r in built.collect()}
    assert len(got) == len(rows) and got[500].depth == 81
    assert (got[600].kind, got[601].in_package, got[602].kind, got[603].kind) == (0, True, 2, 1)


def test_results_tell_total_and_what_is_sorted(spark):
    rows = spark.range(1, 301).select(F.col("id").alias("entry_id"), (F.col("id") % 7).alias("score"))
    by = [F.desc("score"), F.col("entry_id")]
    whole = search.results(rows, by).orderBy("rank").collect()
    assert [r.entry_id for r in whole] == sorted(range(1, 301), key=lambda i: (-(i % 7), i)) and {(r.total, r.sorted_count) for r in whole} == {(300, 300)}
    some = search.results(rows, by, full=200, head=10).collect()
    assert len(some) == 300 and sorted(r.rank for r in some if r.rank) == list(range(1, 11)) and {(r.total, r.sorted_count) for r in some} == {(300, 10)}


def test_many_results_are_all_ranked(spark):
    rows = spark.range(1, 7001).select(F.col("id").alias("entry_id"), (F.col("id") % 7).alias("score"))
    got = search.results(rows, [F.desc("score"), F.col("entry_id")], full=200).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 7001)) and {(r.total, r.sorted_count) for r in got} == {(7000, 7000)}
    assert [r.entry_id for r in got] == sorted(range(1, 7001), key=lambda i: (-(i % 7), i))


def test_files_of_equal_score_go_by_id(spark):
    files = spark.createDataFrame([(i, f"n{i}", 5, 0, 0) for i in (9, 10, 100)], "entry_id long, name string, score long, mtime long, size long")
    heads = spark.createDataFrame([("x", "t", 5, 0)], "topic_id string, title string, score long, modified long")
    both = search.merged_with_topics(files, heads, search.Options()).orderBy(F.desc("key"), "is_topic", "id", "item")
    assert [r.item for r in both.collect()] == ["f:9", "f:10", "f:100", "t:x"]
    assert search.takes_topics(search.Options()) and not search.takes_topics(search.Options(kind=4)) and search.takes_topics(search.Options(kind=4), alone=True)


def test_cursor_never_falls(spark, tmp_path):
    folder = str(tmp_path / "cat")
    feed.start_with(spark.createDataFrame([("/a", 1, 1)], "rel_path string, size long, mtime long"), folder)
    batch = lambda *rows: spark.createDataFrame(rows, feed.CHANGE)
    feed.apply_batch(batch(("/a", 50, 0, True, 9, 9)), 0, folder)
    feed.apply_batch(batch(("/a", 20, 0, True, 3, 3)), 1, folder)  # late
    assert feed.pointer(spark, folder)[2] == 50
    feed.apply_batch(batch(("/a", 30, 0, False, 0, 0)), 2, folder)
    assert [tuple(r) for r in feed.current(spark, folder).collect()] == [("/a", 9, 9)]


def test_excluded_folders():
    assert coverage.normalized("/a//b/./c/") == "/a/b/c" and coverage.normalized("a") is None and coverage.normalized("/e\u0301") == "/\u00e9"
    assert coverage.holds("/", "/x") and coverage.holds("/a", "/a/b") and not coverage.holds("/a", "/ab") and not coverage.holds("a", "/a")
    assert coverage.with_exclusions(["/a/b", "/c"], ["/a", "/c/d", "x", "/e/"]) == ["/c", "/a", "/e"]


def test_merged_examples(spark):
    parts = spark.createDataFrame([("hidden", 7, 1, "/a;/b;/c;/d;/e"), ("hidden", 1, 2, "/z"), ("package", 2, 2, "/p;/q"), ("package", 1, 1, "/o")], "reason string, n long, part int, examples string")
    assert {tuple(r) for r in coverage.merged(parts).collect()} == {("hidden", 8, 2, "/a;/b;/c;/d;/e"), ("package", 3, 2, "/o;/p;/q")}
