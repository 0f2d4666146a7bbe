"""Rows in folders, and catalogs kept up to date, against plain Python over random trees."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import catalog, changes, subtrees, upkeep


def tree(rng, n):
    """path -> (is_dir, size, mtime) of a random tree whose names sort around the slash."""
    out = {}
    for k in range(n):
        base = rng.choice(["", *(p for p, x in out.items() if x[0] and p.count("/") < 5)])
        path = f"{base}/{rng.choice('ab!- .0z')}{rng.choice(['', 'b', ' ', '.'])}{k % 7}"
        if path.lower() not in {p.lower() for p in out}:
            is_dir = rng.random() < 0.5
            out[path] = (is_dir, 0 if is_dir else k, 1000 + k)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_holding(spark, seed):
    rng = random.Random(seed)
    paths = sorted(tree(rng, 150))
    roots = [*rng.sample(paths, 12), "/nowhere"] + (["/"] if seed == 2 else [])
    rows = spark.createDataFrame([(p,) for p in paths], "rel_path string").repartition(6)
    marks = spark.createDataFrame([(p, f"m{p}") for p in roots], "path string, note string")
    for itself in (True, False):
        got = {r.rel_path: [(x.path, x.note) for x in r.held] for r in subtrees.holding(rows, marks, itself=itself).collect()}
        inside = lambda p, r, itself=itself: r == "/" or p.startswith(r + "/") or itself and p == r
        assert got == {p: [(r, f"m{r}") for r in sorted(roots, key=len) if inside(p, r)] for p in paths}
    assert subtrees.holding(rows, marks.limit(0)).where("size(held) > 0").count() == 0
    plan = changes.swept(rows, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.format_string("%04d", F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert sorted((r.k, r.n) for r in subtrees.numbered(rows, "k", 50, "n").collect()) == [(f"{i:04}", 50 + i) for i in range(1000)]


def entries(spark, model):
    ids = {p: k for k, p in enumerate(sorted(model, key=lambda p: p.replace("/", "\0")), 1)}
    rows = [(ids[p], ids.get(p.rpartition("/")[0], 0), p.rpartition("/")[2], d, s, m) for p, (d, s, m) in model.items()]
    built = catalog.build(spark.createDataFrame(rows, "entry_id long, parent_id long, name string, is_dir boolean, size long, mtime long"))
    return built.select(*upkeep.ENTRY).cache()


SEEN = "path string, present boolean, is_dir boolean, size long, mtime long, event_id long"


@pytest.mark.parametrize("seed", range(2))
def test_upkeep_equals_a_new_scan(spark, seed):
    """Files and folders come, go, move, grow and change type; new folders are listed; ids of what stays stay."""
    rng = random.Random(seed)
    model = tree(rng, 40)
    rows, event = entries(spark, model), 0
    for _ in range(3):
        before, touched, listed = dict(model), [], []
        for _ in range(6):
            folders = ["", *(p for p, x in model.items() if x[0])]
            what = rng.choice(["new", "deep", "gone", "grow", "type", "move"])
            some = rng.choice(sorted(model))
            drop = lambda p: [model.pop(q) for q in [*model] if q == p or q.startswith(p + "/")]
            event += 1
            if what == "new":
                p = f"{rng.choice(folders)}/new{event}"
                model[p] = (False, event, event)
                touched.append((p, event))
            elif what == "deep":
                p = f"{rng.choice(folders)}/deep{event}"
                model |= {p: (True, 0, event), f"{p}/x": (True, 0, event), f"{p}/x/leaf": (False, event, event)}
                touched.append((rng.choice([p, f"{p}/x/leaf"]), event))
                listed += [p, f"{p}/x", f"{p}/x/leaf"]
            elif what == "gone":
                drop(some)
                touched.append((some, event))
            elif what == "grow" and not model[some][0]:
                model[some] = (False, 5000 + event, event)
                touched.append((some, event))
            elif what == "type":
                was = model[some][0]
                drop(some)
                model[some] = (not was, 0 if not was else event, event)
                touched.append((some, event))
            elif what == "move" and model[some][0]:
                p = f"{rng.choice([f for f in folders if f != some and not f.startswith(some + '/')])}/moved{event}"
                for q in [q for q in [*model] if q == some or q.startswith(some + "/")]:
                    model[p + q[len(some) :]] = model.pop(q)
                    listed.append(p + q[len(some) :])
                touched += [(some, event), (p, event)]
        seen = [(p, p in model, *model.get(p, (False, 0, 0)), e) for p, e in touched]
        found = [(p, *model[p]) for p in listed if p in model]
        new = upkeep.upkept(rows, spark.createDataFrame(seen, SEEN), spark.createDataFrame(found, "path string, is_dir boolean, size long, mtime long")).cache()
        got, old = new.collect(), {r.rel_path: r for r in rows.collect()}
        assert {r.rel_path: (r.is_dir, r.size, r.mtime) for r in got} == model
        ids = {r.entry_id: r for r in got}
        assert len(ids) == len(got)
        for r in got:
            up = r.rel_path.rpartition("/")[0]
            assert (ids[r.parent_id].rel_path if r.parent_id else "") == up and r.parent_id < r.entry_id and "/".join(["", *r.ancestors, r.name]) == r.rel_path and r.depth == len(r.ancestors) + 1
            kept = r.rel_path in before and r.rel_path in old and old[r.rel_path].is_dir == r.is_dir and not any(r.rel_path == p or r.rel_path.startswith(p + "/") for p, _ in touched if p not in model or p in before and before[p][0] != model[p][0])
            assert r.entry_id == old[r.rel_path].entry_id if kept else r.entry_id > max(o.entry_id for o in old.values()) or r.rel_path in old
        rows = new


def test_what_is_left_out_and_names_in_other_case(spark):
    rows = entries(spark, {"/a": (True, 0, 1), "/a/Doc.md": (False, 5, 1), "/a/x.zip": (False, 5, 1), "/keep": (True, 0, 1)})
    seen = [
        ("/a/doc.md", True, False, 9, 2, 1), ("/a/DOC.md", True, False, 7, 3, 2), ("/a/x.zip", True, False, 6, 6, 3), ("/a/y.zip", True, False, 6, 6, 4), ("/a/node_modules/z", True, False, 1, 1, 5),
        ("/out/z", True, False, 1, 1, 6), ("/keep/", True, True, 0, 8, 7), ("/", True, True, 0, 0, 8), ("/b", False, False, 0, 0, 9), ("/b/c/d", True, False, 4, 4, 10),
    ]
    got = {r.rel_path if r.entry_id > 4 else r.entry_id: (r.name, r.size, r.mtime) for r in upkeep.upkept(rows, spark.createDataFrame(seen, SEEN), None, ["/out"], ["node_modules"], ["zip"]).collect()}
    assert got == {1: ("a", 0, 1), 2: ("DOC.md", 7, 3), 4: ("keep", 0, 8), "/b": ("b", 0, 4), "/b/c": ("c", 0, 4), "/b/c/d": ("d", 4, 4)}
