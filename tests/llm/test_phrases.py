"""Substring dedup, collocations and lexical search against plain Python, over odd texts and small slices."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamarack.llm import collocations, lexical_search, registry, substring_dedup

low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
BLANK = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def removed_words(rows, window=13):
    """(doc_id, text) -> words, places of removed ones, for each row."""
    first = {}
    split = [(i, re.findall(BLANK, t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                x = tuple(w[k : k + window])
                first[x] = min(i, first.get(x, i))
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((i, w, gone))
    return out


def as_rows(told):
    return sorted(((i, len(w), len(g), sha(" ".join(x for k, x in enumerate(w) if k not in g))) for i, w, g in told), key=str)


def test_op11(spark, sf, corpus):
    got = registry.queries()["op11_substring_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == as_rows(removed_words([r[:2] for r in corpus]))


@pytest.mark.parametrize(("window", "first"), [(13, 4), (13, 13), (5, 1), (2, 1), (1, 1)])
def test_repeats_at_any_window(spark, window, first):
    """Few words, so that windows of all lengths repeat, inside one row too; slices of a few texts, many shards."""
    rng = random.Random(window)
    rows = [(i // 2 if i % 7 else None, " ".join(rng.choice("a b c") for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "a b c " * 2000), (93, "a b c " * 2000), (93, "a b c " * 2000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, slice string, answers int, state int").repartition(4)
    out = substring_dedup.without_repeats(docs, window, first, slice_bytes=300, shards=50).collect()
    told = removed_words(rows, window)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == as_rows(told)
    for r in out:
        assert sha(r.kept) == r.kept_sha256 and sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    spans = Counter((r.doc_id, r.n_words, tuple((s.start, s.stop) for s in r.spans)) for r in out)

    def runs(gone):
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        return tuple((a, next(b for b in range(a, a + len(gone) + 2) if b not in gone)) for a in starts)

    assert spans == Counter((i, len(w), runs(g)) for i, w, g in told)


def test_levels_double():
    for window in range(1, 70):
        x = substring_dedup.lengths(window)
        assert x[-1] == window and all(a < b <= 2 * a for a, b in zip(x, x[1:], strict=False)) and x[0] <= 4


def plain_collocations(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[k : k + size])) for k in range(len(w) - size + 1))
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    absorbed = set()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= 80 * f[lang, w[i:j]]:
                    absorbed.add((lang, w[i:j]))
    by = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in absorbed:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, some in by.items() for rank, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1))


@pytest.mark.parametrize(("least", "top", "spacing"), [(30, 2000, 16), (3, 50, 2), (2, 2000, 1000), (1, 300, 1)])
def test_collocations(spark, least, top, spacing, monkeypatch):
    """Triggers at every word, at some and at none; words named like langs; pieces of any length; odd characters."""
    monkeypatch.setattr(collocations, "dictionary", lambda d, longest, _, make=collocations.dictionary: make(d, longest, spacing))
    monkeypatch.setattr(collocations, "_level", lambda n, longest, _, make=collocations._level: make(n, longest, spacing))
    monkeypatch.setattr(collocations, "_frequent", lambda longest, _, make=collocations._frequent: make(longest, spacing))
    rng = random.Random(least)
    words = ["en", "de", "und", "New", "york", "CITY", "é", "ÄÖ", "x😀y", "a b", "it's", "\x01"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und", ""]), say(rng.randrange(60))) for _ in range(80)]
    rows += [("en", "New York city " * 700), ("en", None), ("de", ""), ("de", " .,;\n"), (None, "new york " * 40), ("fr", "once only")] + [("en", say(50))] * 9
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, freq string, phrase int").repartition(3)
    got = collocations.collocations(docs, least=least, top=top, slice_bytes=700, shards=40).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, least, top)


def test_chunks_hold_each_phrase_once(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(3000))
    docs = spark.createDataFrame([("en", text)] * 3, "lang string, text string")
    d = collocations.dictionary(docs, 4, 4).collect()
    assert len(d) > 100 and all(len(r.text.split()) >= 4 for r in d) and min(r.freq for r in d) >= 3
    assert Counter({r.phrase: r.a for r in collocations.frequent_phrases(docs, 4, 1, 4).where("n_words = 4").collect()}) == Counter(
        {" ".join(x): 3 * n for x, n in Counter(zip(*(text.split()[k:] for k in range(4)), strict=False)).items()}
    )


def plain_search(rows, items, k=10):
    terms = lambda t: re.findall(TERM, low(t))
    tf = [(i, Counter(terms(t))) for i, t in rows]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in tf:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in {*terms(text)} if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_op13(spark, sf, corpus, item_bytes, monkeypatch):
    monkeypatch.setattr(lexical_search, "ranked", lambda d, b, search=lexical_search.ranked: search(d, b, item_bytes=item_bytes, cells=40))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = registry.queries()["op13_lexical_search"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain_search([r[:2] for r in corpus], items)


def test_best_of_a_task_is_cut_as_it_goes():
    rng = np.random.default_rng(3)
    scores, ids, no_id = rng.integers(0, 5, (600, 4)), rng.permutation(600), rng.integers(0, 2, 600)
    best = lexical_search._Best(4, 7, pool=30)
    for a in range(0, 600, 20):
        best.add(scores[a : a + 20], ids[a : a + 20], no_id[a : a + 20])
    want = sorted((i, -scores[d, i], no_id[d], ids[d]) for i in range(4) for d in range(600) if scores[d, i] > 0)
    want = [x for i in range(4) for x in [y for y in want if y[0] == i][:7]]
    item, score, without, doc = best.cut()
    assert sorted(zip(item, -score, without, doc, strict=True)) == want


def test_search_of_ties_and_odd_rows(spark):
    rows = [(5, "cat"), (3, "cat"), (None, "cat"), (4, "Cat-cat!"), (4, "CAT"), (9, "über_cat é"), (10, None), (11, "--"), (12, "catalog")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, key int")
    items = [(1, "cat ÜBER"), (1, "cat über"), (None, "É é"), (2, None), (3, ""), (4, "dog")]
    table = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, terms int")
    for k in (1, 3, 10):
        assert sorted(map(tuple, lexical_search.ranked(docs, table, k).collect()), key=str) == plain_search(rows, items, k)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert substring_dedup.without_repeats(empty).collect() == []
    assert collocations.collocations(empty).collect() == []
    assert lexical_search.ranked(empty, items).collect() == []
    none = lexical_search.ranked(docs, items.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    nulls = spark.createDataFrame([(None, None, None), (1, None, "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.n_words) for r in substring_dedup.without_repeats(nulls).collect()} == {(None, 0), (1, 0)}
    assert collocations.collocations(nulls).collect() == []
    assert lexical_search.ranked(nulls, items).collect() == []
