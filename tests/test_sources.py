"""Packages in listings, session metadata, tails of growing files, gaps in the feed, pasted paths."""

import json

import pytest

from tamarack.operators import catalog, changes, coverage, search
from tamarack.plans import language
from tamarack.sources import listing, sessions, tails, transcripts
from tamarack.streaming import feed


def test_packages_are_listed_but_not_entered(spark, tmp_path):
    for path in ("a/B.app/inside", "C.Framework/Versions", "plain/deep"):
        (tmp_path / path).mkdir(parents=True)
    (tmp_path / "a/B.app/inside/x.txt").write_text("x")
    for depth in (1, 2, 3):
        paths = {r.path for r in listing.listing(spark, str(tmp_path), depth).collect()}
        assert paths == {"/a", "/a/B.app", "/C.Framework", "/plain", "/plain/deep"}
    everything = {r.path for r in listing.listing(spark, str(tmp_path), 2, packages=True).collect()}
    assert everything == paths | {"/a/B.app/inside", "/a/B.app/inside/x.txt", "/C.Framework/Versions"}


def test_file_types_of_any_length_and_script(spark):
    names = ["a.PHOTOSLIBRARYX", "b.\u00c9t\u00e9", "c.E\u0301te\u0301", "d.txt", "photoslibraryx", "e.tar.gz"]
    rows = [(i, 0, n, False, 1, 1) for i, n in enumerate(names, 1)]
    built = catalog.build(spark.createDataFrame(rows, "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long"))
    left = coverage.reasons(built, [], [], ["photoslibraryx", "\u00e9t\u00e9", "GZ"])
    assert {r.entry_id for r in left.where("reason = 'file type'").collect()} == {1, 2, 3, 6}
    told = coverage.explained(left.selectExpr("rel_path AS path"), left, [])
    assert {r.detail for r in told.where("told = 'file type'").collect()} == {"photoslibraryx", "\u00e9t\u00e9", "e\u0301te\u0301", "gz"}


def line(text, kind="user"):
    return json.dumps({"type": kind, "message": {"content": text}}) + "\n"


def test_tails_of_growing_files(spark, tmp_path):
    log, other = tmp_path / "t1.jsonl", tmp_path / "t2.jsonl"
    files = spark.createDataFrame([(str(log),), (str(other),), (str(tmp_path / "gone.jsonl"),)], "file string")
    state = {"cursors": spark.createDataFrame([], tails.CURSOR), "messages": transcripts.messages(spark.createDataFrame([], "file string, value string, offset long"), language.F.col("offset"))}

    def step(n):
        tails.tails(files, state["cursors"]).write.parquet(str(tmp_path / f"tail{n}"))
        tail = spark.read.parquet(str(tmp_path / f"tail{n}"))
        for key, df in (("cursors", tails.moved(state["cursors"], tail)), ("messages", tails.applied(state["messages"], tail))):
            df.write.parquet(str(tmp_path / f"{key}{n}"))
            state[key] = spark.read.parquet(str(tmp_path / f"{key}{n}"))
        return tail.where("value IS NOT NULL").count(), [(r.topic_id, r.body) for r in state["messages"].orderBy("topic_id", "msg_key").collect()]

    log.write_text(line("one") + line("zwei é") + '{"type": "us')  # the last line is not whole yet
    other.write_text("")
    assert step(1) == (2, [("t1", "one"), ("t1", "zwei é")])
    assert step(2) == (0, [("t1", "one"), ("t1", "zwei é")])
    log.write_text(line("one") + line("zwei é") + line("three").rstrip("\n"))  # whole, though without a line end
    other.write_text(line("other"))
    assert step(3) == (2, [("t1", "one"), ("t1", "zwei é"), ("t1", "three"), ("t2", "other")])
    log.write_text(line("ONE") + line("zwei é") + line("three") + line("four"))  # rewritten
    assert step(4) == (4, [("t1", "ONE"), ("t1", "zwei é"), ("t1", "three"), ("t1", "four"), ("t2", "other")])


def test_heads_of_transcripts(spark):
    records = [("a", {"type": "assistant", "message": {"content": "x" * 300}}), ("a", {"type": "user", "cwd": "/p", "message": {"content": "first\n" + "y" * 200}}), ("a", {"cwd": "/q", "aiTitle": ""})]
    records += [("b", {"type": "user", "message": {"content": "ask"}}), ("b", {"aiTitle": "one"}), ("b", {"customTitle": "two", "aiTitle": "three"}), ("c", "no json")]
    rows = [(f"/d/{k}.jsonl", json.dumps(r), i) for i, (k, r) in enumerate(records)]
    got = transcripts.heads(spark.createDataFrame(rows, "file string, value string, offset long"))
    assert {tuple(r) for r in got.collect()} == {("a", "first " + "y" * 114, "/p", "x" * 220), ("b", "two", "", "ask"), ("c", "", "", "")}


def test_first_lines_and_headers(spark, tmp_path):
    meta = {"type": "session_meta", "payload": {"id": "s1", "cwd": "/p", "source": "cli"}}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text(json.dumps(meta) + "\n" + line("hello"))
    meta["payload"] |= {"id": "s2", "source": {"subagent": "r"}}
    (tmp_path / "a/y.jsonl").write_text(json.dumps(meta) + "\n")
    (tmp_path / "z.jsonl").write_text("no json\n" + json.dumps(meta))
    got = sessions.headers(sessions.first_lines(spark, str(tmp_path))).collect()
    assert [(r.topic_id, r.project, r.archived, r.transcript.endswith("/a/x.jsonl")) for r in got] == [("s1", "/p", False, True)]


@pytest.mark.parametrize("change", [{}, {"version": 2}, {"uid": ""}, {"savedAt": 1.0}, {"nickname": None}, {"type": "t" * 5000}])
def test_account(spark, change):
    now = 1_700_000_000
    primary = {"version": 1, "uid": "u", "nickname": "n", "type": "t", "savedAt": now * 1000.0 - 30 * 86_400_000} | change
    got = sessions.account(spark.createDataFrame([(json.dumps({"primary": primary}),), ("{",), (None,)], "value string"), now)
    assert [r.uid for r in got.collect()] == ([] if change else ["u"])


def test_logs_and_aliases(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "topic_id string")
    logs = spark.createDataFrame([("/p/a.jsonl", 1.0), ("/q/a.jsonl", 2.0), ("/p/x-1.jsonl", 1.0)], "file string, changed double")
    aliases = spark.createDataFrame([("a", "x-1"), ("b", "x-1"), ("c", "../x")], "topic_id string, alias string")
    assert {(r.topic_id, r.transcript) for r in sessions.with_logs(found, logs, aliases).collect()} == {("a", "/q/a.jsonl"), ("b", "/p/x-1.jsonl"), ("c", None)}


def test_removed_folders_take_what_lay_below(spark):
    files = spark.createDataFrame([("/a/b/c", 1, 1), ("/a/bb", 1, 1), ("/d", 1, 1)], "rel_path string, size long, mtime long")
    seen = [("/a/b", 5, False, 0, 0), ("/a/b/early", 3, True, 2, 2), ("/a/b/late", 7, True, 3, 3), ("/d", 4, True, 9, 9)]
    got = changes.upserted(files, spark.createDataFrame(seen, "path string, event_id long, present boolean, size long, mtime long"))
    assert {tuple(r) for r in got.collect()} == {("/a/bb", 1, 1), ("/a/b/late", 3, 3), ("/d", 9, 9)}


def test_renamed_at_any_depth(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x"]), (3, [])], "entry_id long, ancestors array<string>")
    moves = spark.createDataFrame([("/a/b", "B"), ("a", "A"), ("/b", "no")], "old string, new string")
    assert {r.entry_id: r.ancestors for r in changes.inherited(rows, moves).collect()} == {1: ["A", "B", "c"], 2: ["A", "x"], 3: []}


def test_gap_is_closed_by_a_listing(spark, tmp_path):
    folder = str(tmp_path / "cat")
    files = lambda *rows: spark.createDataFrame(list(rows), "rel_path string, size long, mtime long")
    batch = lambda *rows: spark.createDataFrame(list(rows), feed.CHANGE)
    now = lambda: {tuple(r) for r in feed.current(spark, folder).collect()}
    feed.start_with(files(("/a", 1, 1)), folder)
    feed.apply_batch(batch(("/b", 10, 0, True, 2, 2)), 0, folder)
    feed.apply_batch(batch(("/c", 20, changes.IDS_WRAPPED, True, 3, 3)), 1, folder)
    feed.apply_batch(batch(("/d", 1, 0, True, 4, 4), ("/b", 2, 0, False, 0, 0)), 2, folder)
    assert now() == {("/a", 1, 1), ("/b", 2, 2)} and feed.pointer(spark, folder)[2:4] == (10, 1)
    feed.apply_batch(batch(("/", 3, changes.KERNEL_DROPPED, True, 0, 0)), 3, folder)
    assert not feed.rescanned(files(("/x", 5, 5)), folder, begun=2)  # lost again since the listing began
    assert feed.pointer(spark, folder).gap == 1
    feed.apply_batch(batch(("/e", 4, changes.MUST_SCAN, True, 6, 6)), 4, folder)  # not the root's: no loss
    assert feed.rescanned(files(("/x", 5, 5), ("/b", 2, 2)), folder, begun=3)
    assert now() == {("/x", 5, 5), ("/c", 3, 3), ("/d", 4, 4), ("/", 0, 0), ("/e", 6, 6)}
    assert feed.pointer(spark, folder)[2:4] == (4, None)
    feed.apply_batch(batch(("/e", 5, 0, False, 0, 0), ("/d", 4, 0, False, 0, 0)), 5, folder)
    assert now() == {("/x", 5, 5), ("/c", 3, 3), ("/d", 4, 4), ("/", 0, 0)}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (" report ", " report "), (" /a/b ", "/a/b"), ("'/a b/c'", "/a b/c"), ('"/a\\"b"', '/a"b'), ("'/a'b'", "'/a'b'"), ("file://host/a%20b%C3%A9", "/a bé"), ("file:///a%2", "file:///a%2"),
        ("file:///a%FF", "file:///a%FF"), ("/a\\ b\\(1\\)", "/a b(1)"), ("/src/x.py:12:3", "/src/x.py"), ("/src/x.py:1:2:3", "/src/x.py:1"), ("/src/x:12", "/src/x:12"), ("~/x.y:7", "~/x.y"), ("a:12", "a:12"),
    ],
)
def test_pasted(line, want):
    assert language.pasted(line) == want


def test_whole_paths(spark):
    rows = [(1, 0, "my dir", True, 0, 0), (2, 1, "a b.txt", False, 1, 1), (3, 1, "c.txt", False, 1, 1)]
    built = catalog.build(spark.createDataFrame(rows, "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long"))
    ids = lambda text, **o: {r.entry_id for r in search.found(built, text, search.Options(**o)).collect()}
    assert ids("/my dir/a b.txt") == {2} and ids("'/my dir'") == {1, 2, 3} and ids("~/a b.txt", home="/my dir") == {2}
    assert ids("/my dir|c.txt") == {1, 3} and ids("/my c.txt") == {3}  # no paths of entries: words and paths
