"""Search lines: tokens, ranges, scores and the worked examples of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions import names, present
from tamarack.operators import catalog, search
from tamarack.plans import language

NOW = 1706745600


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        (1, 0, "src", True), (2, 0, "node_modules", True), (3, 0, "Demo.app", True), (4, 0, ".hiddenDir", True), (5, 1, "deep", True), (10, 1, "ReadMe.txt", False),
        (11, 2, "readme.js", False), (12, 3, "Info.plist", False), (13, 4, "secret.txt", False), (14, 5, "photo10.jpg", False), (15, 5, "photo2.jpg", False),
        (16, 0, "README.md", False), (17, 0, "项目文档.md", False), (18, 0, "ÉCLAIR.md", False), (19, 0, "my_readme-old.tar.gz", False),
    ]
    entries = spark.createDataFrame([(*r, 0 if r[3] else 1000 * r[0], NOW - 86_400 * r[0]) for r in rows], "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long")
    return catalog.build(entries).cache()


def ids(tree, line, **o):
    return {r.entry_id for r in search.found(tree, line, search.Options(now=NOW, **o)).collect()}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("readme", {10, 11, 16, 19}), ("readme !node_modules", {10, 16, 19}), ("readme !path:node_modules", {10, 16, 19}), ("case:README", {16}), ("*.md", {16, 17, 18}),
        ("photo?.jpg", {15}), ("src/", {1, 5, 10, 14, 15}), ("path:src/deep", {5, 14, 15}), ("ext:md;txt", {10, 13, 16, 17, 18}), ("kind:image", {14, 15}), ("kind:app", {3}),
        ("file: demo", {3}), ("folder:s", {1, 2}), ("photo2|photo10", {14, 15}), ("size:>15kb", {16, 17, 18, 19}), ("xm", {17}), ("wendang", {17}), ("éclair", {18}),
        ("regex:^photo\\d+\\.", {14, 15}), ("foo kind:bad | readme", set()), ("readme kind:bad", {10, 11, 16, 19}), ("dm:2d", {1, 2}), ('"my_readme-old"', {19}), ("!file:readme", {1, 2, 3, 4, 5, 12, 13, 14, 15, 17, 18}),
    ],
)
def test_matches(tree, line, want):
    assert ids(tree, line) == want


def test_worked_score(spark):
    row = [(1, 1, 0, "alpha.txt", 5, 0, False)]
    df = spark.createDataFrame(row, "entry_id long, i int, parent_id long, name string, size long, mtime long, is_dir boolean")
    df = df.withColumns({"rel_path": F.lit("/x/alpha.txt"), "depth": F.lit(2), "ancestors": F.array(F.lit("x"))})
    for user, mtime, want in ((False, 0, 774), (True, 0, 834), (True, 2**32 - 1, 894)):
        cat = catalog.classified(df.withColumn("mtime", F.lit(mtime)), user)
        assert search.found(cat, "a", search.Options(now=NOW)).first().score == want


def test_quality_against_the_byte_rules(spark):
    def rule(name, needle):
        low, best = name.lower(), 0
        for p in range(len(name) - len(needle) + 1):
            if low[p : p + len(needle)] == needle:
                a, b = name[p - 1] if p else "", name[p]
                rest = name[len(needle) :]
                if not p:
                    q = 4 if not rest or rest.startswith(".") and rest.count(".") == 1 else 3
                elif a in " -_.([+," or a.islower() and b.isupper() or a.isdigit() and b.isalpha() or b.isdigit() and a.isalpha():
                    q = 2
                else:
                    q = 1
                best = max(best, q)
        return best

    rng = random.Random(42)
    pick = lambda n: "".join(rng.choice("aAbB1 -._(") for _ in range(rng.randint(1, n)))
    pairs = [(pick(9), pick(2).lower()) for _ in range(3000)]
    for needle in sorted({n for _, n in pairs})[:60]:
        own = [x for x, _ in pairs]
        df = spark.createDataFrame([(x,) for x in own], "name string").withColumn("folded", names.fold(F.col("name")))
        got = [r.q for r in df.select(names.match_quality(F.col("name"), F.col("folded"), needle).alias("q")).collect()]
        assert got == [rule(x, needle) for x in own], needle
        if needle > "b":
            break


def test_natural_order(tree):
    got = search.search(tree, "photo", search.Options(sort="name", ascending=True, now=NOW)).orderBy("rank").collect()
    assert [r.name for r in got] == ["photo2.jpg", "photo10.jpg"]


def test_ranges():
    assert language.size_range(">1.5mb") == (1_500_001, language.MOST)
    assert language.size_range("5mb..1mb") is None and language.size_range("10zz") is None and language.size_range("<1kb") == (0, 999)
    assert language.date_range("2026-02-31", NOW) is None and language.date_range("nope", NOW) is None
    assert language.date_range("2024-01", NOW) == (1704067200, 1706745599)
    assert language.date_range("7d", NOW) == (NOW - 604_800, NOW)
    assert language.understand("foo kind:bad", NOW).problems == [("kind", "kind:bad", 4, 12)]
    assert language.size_range(".5mb") == (500_000, 500_000) and language.size_range(">1e3") == (1001, language.MOST) and language.date_range("0d", NOW) == (NOW, NOW)
    assert language.understand("ext:.pdf", NOW).clauses[0][0].value == [".pdf"] and language.understand("e\u0301", NOW).clauses[0][0].value == "\u00e9"
    assert language.understand("regex:[", NOW).clauses[0][0].value == "regex:["


def test_local_days():
    """New York: 10 March 2024 has 23 hours, 3 November 25; weeks may begin on Sunday."""
    noon = 1710090000  # 2024-03-10 13:00 EDT
    day = language.date_range("today", noon, "America/New_York")
    assert day[1] - day[0] + 1 == 23 * 3600 and language.date_range("yesterday", noon, "America/New_York")[1] == day[0] - 1
    day = language.date_range("2024-11-03", noon, "America/New_York")
    assert day[1] - day[0] + 1 == 25 * 3600
    assert language.date_range("week", noon, "America/New_York", 6)[0] == language.date_range("today", noon, "America/New_York")[0]
    assert language.date_range("36500d", NOW) is not None and language.date_range("36501d", NOW) is None and language.date_range("<1970", NOW) is None


def test_problems_have_places_and_wait_for_the_caret():
    line = 'doc kind:bad "size:x y"|dm:never !regex:['
    told = language.understand(line, NOW).problems
    assert [(p.kind, line[p.start : p.end]) for p in told] == [("kind", "kind:bad"), ("size", '"size:x y"'), ("date", "dm:never"), ("regex", "!regex:[")]
    assert [p.kind for p in language.understand(line, NOW, caret=8).problems] == ["size", "date", "regex"]
    assert language.understand(line, NOW, composing=True).problems == [] and len(language.understand(line, NOW, composing=True).clauses) == 1
    assert language.understand("kind:bad kind:doc kind:bad", NOW).problems == [("kind", "kind:bad", 0, 8), ("kind", "kind:bad", 18, 26)]


def test_every_han_character_has_a_syllable(spark):
    table = names.syllables(spark)
    assert len(table) == 0x9FFF - 0x4E00 + 1 and sum(x.islower() and x.isascii() for x in table) > 20_900 and table[0] == "yi" and table[ord("女") - 0x4E00] == "nu"
    rows = spark.createDataFrame([("项目文档.MD",), ("É文x😀Ü.md",), ("éa",), ("ÉA",), ("plain",)], "name string")
    got = [r[0] for r in rows.withColumn("t", names.syllable_table(spark)).select(names.alternate_keys(F.col("name"), F.col("t"))).collect()]
    assert got == [["xiangmuwendang.md", "xmwd.md"], ["Éwenx😀Ü.md", "Éwx😀Ü.md"], [], ["éa"], []]


def test_syllables_are_an_option(tree):
    assert ids(tree, "xmwd") == {17} and ids(tree, "xmwd", syllables=False) == set() and ids(tree, "éclair", syllables=False) == {18} and ids(tree, "文档") == {17}
    assert search.found(tree, "xmwd", search.Options(now=NOW)).first().score > search.found(tree, "mwd", search.Options(now=NOW)).first().score


def test_patterns_keep_to_a_budget(spark, tree):
    """A name on which backtracking would take for ever is left out, from the negated search too; others are judged as ever."""
    assert [language.may_explode(p) for p in (r"^(a+)+$", "(a|aa)+$", "(?:a?){30}", "a*b*c*d*e", r"^photo\d+\.", "a|b+", "(?<=x)y+[a-z]*")] == [True, True, True, True, False, False, False]
    bad = "a" * 60 + "X"
    rows = tree.where("entry_id = 16").withColumns({"name": F.explode(F.array(F.lit(bad), F.lit("aaaa"), F.lit("b")))})
    find = lambda line: sorted(r.name for r in search.found(rows, line, search.Options(sort="name", now=NOW)).collect())
    assert find('"regex:^(a|aa)+$"') == ["aaaa"] and find('!"regex:^(a|aa)+$"') == ["b"]
    assert find('regex:X$|"regex:^(a|aa)+$"') == ["aaaa", bad] and find('"regex:^(a|aa)+$"|regex:X$') == ["aaaa"]
    assert find("regex:^(a+)+$") == ["aaaa"] and find("!regex:^(a+)+$") == [bad, "b"]  # this one the engine tells in time


def test_paths_below_another_root(tree):
    assert ids(tree, "/Vol/src/deep", root="/Vol") == {5, 14, 15} and ids(tree, "!vol", root="/Vol") == set()
    spaced = tree.withColumn("rel_path", F.when(F.col("entry_id") == 16, "/a b/c d.md").otherwise(F.col("rel_path")))
    for line, o in (("/a b/c d.md", {}), ("a b/c d.md", {}), ("b/c d.md", {"folder": "/a b"}), ("~/c d.md", {"home": "/a b"}), ("/Vol/a b/c d.md", {"root": "/Vol"})):
        whole = search.found(spaced, line, search.Options(now=NOW, **o))
        assert ({r.entry_id for r in whole.collect()} == {16}) == (line != "b/c d.md"), line


def test_narrowing_equals_full_search(tree):
    for chain in (["r", "re", "readme"], ["x", "xm"], ["re", "readme !node_modules"]):
        rows = tree
        for before, after in zip(chain, chain[1:], strict=False):
            assert search.can_narrow(before, after)
            rows = search.found(rows, before, search.Options(now=NOW)).drop("score")
        assert ids(rows, chain[-1]) == ids(tree, chain[-1])
    assert not search.can_narrow("kind:image", "kind:image a") and not search.can_narrow("doc", "do") and not search.can_narrow("dm:1d", "dm:1d")


def test_highlights(spark):
    df = spark.createDataFrame([("doc doc-1",), ("",), ("xx",)], "f string")
    got = [[tuple(s) for s in r.h] for r in df.select(present.highlights(F.col("f"), ["doc", "oc-"]).alias("h")).collect()]
    assert got == [[(0, 3), (4, 8)], [], []]


def test_literals_and_units(spark):
    say = lambda line: language.literals(language.understand(line, NOW))
    assert say("a*b?c !d case:E file:f folder:g|h path:i ext:md") == ["a", "b", "c", "e", "f", "h"] and say("* ! !x") == [] and say("aa AA") == ["aa"]
    df = spark.createDataFrame([("x😀ab😀😀ab",)], "f string")
    assert [tuple(s) for s in df.select(present.in_utf16(F.col("f"), present.highlights(F.col("f"), ["ab", "😀a"])).alias("h")).first().h] == [(1, 5), (7, 11)]


def test_patterns_are_judged_by_the_engine_that_runs_them(tree):
    assert ids(tree, "regex:\\p{Lu}LA") == {18} and language.understand(r"a regex:(?P<a>d)", NOW).problems
    assert ids(tree, r"md regex:(?P<a>d)") == ids(tree, "md")
