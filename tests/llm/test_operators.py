"""General interfaces and odd inputs: empty tables, clashing columns, ties, ledgers, weights."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import decontaminate, fingerprints, graph, licenses, mixing, ngram_join, pii, secrets, suffix_dedup, token_counts, toxicity


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert mixing.mix(empty).count() == 0
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0
    assert fingerprints.with_next(empty).count() == 0
    assert ngram_join.link_components(empty).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.find_matches(empty, items).count() == 0
    assert secrets.find_secrets(empty).count() == 0


def test_empty_benchmark_and_labels(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).where("n_hit > 0").count() == 0
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).agg(F.max("score")).first()[0] == 0


def test_clashing_columns_are_refused(docs):
    for column, run in [("score", lambda d: toxicity.score(d, {})), ("findings", secrets.find_secrets), ("blocks", licenses.scan_licenses), ("items", lambda d: decontaminate.contamination(d, d))]:
        with pytest.raises(ValueError, match=column):
            run(docs.withColumn(column, F.lit(1)))


#: Names that the library uses inside.
INSIDE = ("_doc_id", "_digest", "_id", "__digest", "slot", "block", "k", "nth", "weight", "total", "mix_source", "score", "findings", "blob", "n_words", "n_hit", "items", "digest", "name", "key", "_rest", "a", "b", "copies", "component_id")


def test_filters_take_columns_of_any_name(spark, sf, docs):
    """Stages and operators that return all columns of docs keep those that are named as their own."""
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in INSIDE}).cache()
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ngram_join.one_of_each(wide).count() == ngram_join.one_of_each(docs).count()
    assert decontaminate.clean(wide, benchmark).count() == decontaminate.clean(docs, benchmark).count()
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, sf), stage(spark, wide, sf)
        own = [c for c in out.columns if c not in wide.columns]
        assert out.columns == [*wide.columns, *own] and len(own) == (5 if name == "mix" else 0)
        assert out.where(" OR ".join(f"`{c}` <> 'own {c}' OR `{c}` IS NULL" for c in INSIDE)).count() == 0
        assert sorted(out.select(docs.columns).collect(), key=str) == sorted(plain.select(docs.columns).collect(), key=str)
    mixed = mixing.mix(wide)
    assert mixed.columns[-5:] == ["_slot", "_block", "place", "release", "deadline"]


def test_schedule_of_many_slots_and_sources(spark):
    """A hundred thousand slots; and more sources than a thousand keep the proportions of their square roots."""
    slots = mixing.schedule(spark.createDataFrame([("a", 50021), ("b", 49999)], "source string, weight long").coalesce(1), 100020)
    ahead = slots.withColumn("off", F.abs((F.col("k") + 1) * 100020.0 / F.when(F.col("source") == "a", 50021).otherwise(49999) - F.col("slot") - 1))
    assert slots.count() == 100020 == slots.select("slot").distinct().count() and ahead.agg(F.max("off")).first()[0] <= 2.01
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.when(F.col("id") < 10, 100).otherwise(1).alias("n"))
    weights = mixing.sqrt_weights(rows.select("source", F.explode(F.sequence(F.lit(1), F.col("n")))))
    got = {r.source: r.weight for r in weights.collect()}
    assert len(got) == 3000 and {got[f"s{k}"] for k in range(10)} == {155} and {got[f"s{k}"] for k in range(10, 3000)} == {16}


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJ.eyJ." * 130_000, "eyJa.eyJ" * 130_000, "-----BEGIN " * 90_000, "-----BEGIN " + "A " * 500_000, "password " * 110_000, "password" + " " * 1_000_000, "a" * 1_000_000, "ghp_" * 260_000, "xoxa-" * 200_000, "AKIA" * 260_000, "1.1." * 250_000, "4 " * 500_000, "+1 " * 330_000, "a@a." * 250_000, "@" * 1_000_000, "the of " * 150_000, "mit license " * 80_000, "b4d " * 250_000])
def test_long_texts_of_every_rule_take_seconds(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "clean")], "doc_id long, text string")
    began = time.monotonic()
    assert secrets.find_secrets(docs).count() == 2
    assert licenses.scan_licenses(docs).select("blocks").count() == 2
    assert docs.select(F.size(fingerprints.signatures(F.col("text")))).collect() and time.monotonic() - began < 60


def test_linear_token_rule_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice(["eyJ", "e", "y", "J", ".", "a", "-", " ", ".eyJ"]) for _ in range(rng.randrange(25)))
        assert [m.span() for m in secrets.RULES["jwt"][1].finditer(t)] == [m.span("span") for m in secrets._LINEAR["jwt"].finditer(t)]


def test_extra_columns_stay(docs):
    wide = docs.withColumns({"n": F.lit(1), "key": F.lit("k"), "name": F.lit(2.5)})
    assert {*wide.columns} < {*secrets.find_secrets(wide).columns}
    assert ngram_join.link_components(wide).count() == wide.count()
    assert suffix_dedup.without_repeats(wide, keep_text=False).count() == wide.count()
    assert mixing.mix(wide.drop("k")).count() == wide.count()


@pytest.mark.parametrize("weights", [{"a": 10, "b": 333, "c": 1}, {"a": 7, "b": 7, "c": 14}, {"a": 1, "b": 2, "c": 3, "d": 1000, "e": 3}])
def test_mix_deviates_less_than_a_block(spark, weights):
    """From the target weights themselves, over many rounds of the schedule, until a source runs out."""
    total = sum(weights.values())
    rows = [(1000 * k + i, s) for k, (s, w) in enumerate(weights.items()) for i in range(6 * w + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    table = spark.createDataFrame([*weights.items(), ("unused", total)], "source string, weight long")
    for given, whole in ((table.where("source <> 'unused'"), total), (table, 2 * total)):
        slots = {r.slot: r for r in mixing.mix(docs, given, block=1).collect()}
        assert len(slots) == len(rows) and all(r.release <= r.slot < r.deadline for r in slots.values())
        done = Counter()
        for t in range(6 * whole):
            if t in slots:
                done[slots[t].source] += 1
            assert all(abs(done[s] - (t + 1) * w / whole) < 1 for s, w in weights.items())


def test_mix_refuses_unclear_weights(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, source string")
    for weights in ([("a", 1), ("b", 2)], [("a", 1), ("b", 2), ("", 0)], [("a", 1), ("a", 2), ("b", 2), ("", 1)]):
        with pytest.raises(ValueError):
            mixing.mix(docs, spark.createDataFrame(weights, "source string, weight long"))
    got = mixing.mix(docs, spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, weight long")).collect()
    assert sorted((str(r.doc_id), r.source) for r in got) == [("1", "a"), ("2", None), ("None", "b")]


def test_mix_takes_many_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    rows = mixing.mix(docs, block=2).collect()
    assert len(rows) == 4000 and all(r.release <= r.slot < r.deadline for r in rows)


def test_token_limits_and_quantiles(spark):
    rows = spark.createDataFrame([("a", n, 1 + n % 3) for n in (0, 1, 5, 4095, 4096, 9000)] + [(None, 7, 2)], "source string, n_tokens long, n_docs long")
    sums = token_counts.suffix_sums(rows).cache()
    every = {"a": [n for n in (0, 1, 5, 4095, 4096, 9000) for _ in range(1 + n % 3)], None: [7, 7]}
    for r in token_counts.at_limits(sums, [0, 3, 4096, 10**6]).collect():
        assert r.truncated_tokens == sum(min(n, r.limit) for n in every[r.source]) and r.docs_over == sum(n > r.limit for n in every[r.source])
    got = {(r.source, r.quantile): r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert got["a", 1.0] == 9000 and got[None, 0.5] == 7


def test_graph(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (20, 21), (22, 21), (5, 5), (30, 31), (31, 30)] + [(100, k) for k in range(101, 160)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30, **{k: 100 for k in range(100, 160)}}


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (7, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4), (None, 2, 4), (4, 2, 4), (None, 1, None), (7, 0, 7)], key=str)
    assert fingerprints.with_next(docs).count() == 5 and secrets.find_secrets(docs).count() == 5 and suffix_dedup.without_repeats(docs).count() == 5


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean"), (4, "AKIA" + "Z" * 16), (5, None)], "doc_id long, text string")
    first = secrets.scan_blobs(docs.where("doc_id < 4")).cache()
    assert first.count() == 2
    ledger = secrets.ledger_rows(first)
    again = secrets.scan_blobs(docs, ledger).collect()
    assert {r.blob for r in again} == {r.b for r in docs.where("doc_id > 3").select(secrets.address(F.col("text")).alias("b")).collect()}
    older = ledger.withColumn("version", F.when(F.col("rule") == "hex", 0).otherwise(F.col("version")))
    assert {tuple(r.rules) for r in secrets.scan_blobs(docs.where("doc_id < 4"), older).collect()} == {("hex",)}
    found = {r.doc_id: [tuple(f) for f in r.findings] for r in secrets.find_secrets(docs).collect()}
    assert found == {1: [("assign", 0, 14)], 2: [("assign", 0, 14)], 3: [], 4: [("access", 0, 20)], 5: []}


def test_redaction(spark):
    text = "é token=abcdefgh and AKIA" + "Z" * 16 + " secret=AKIA" + "Q" * 16
    row = secrets.find_secrets(spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string"))
    got = {r.doc_id: r.t for r in row.select("doc_id", secrets.redacted(F.col("text"), F.col("findings")).alias("t")).collect()}
    assert got == {1: "é [SECRET] and [SECRET] [SECRET]", 2: "clean", 3: None}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "one two three four"), (3, "four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "one two three four")], "item_id long, text string")
    near = lambda slop: {r.doc_id for r in decontaminate.find_matches(docs, items, size=4, slop=slop).collect()}
    assert near(0) == {2} and near(1) == {1, 2} and near(2) == {1, 2} and near(6) == {1, 2, 3}


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words, and items of any size: hits are told by whole words."""
    for power in (10, 13):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << power))
        other = one.translate(str.maketrans("ab", "ba"))
        docs = spark.createDataFrame([(1, f"{one} w x y z"), (2, f"{other} w x y z"), (3, f"{one}  W x y Z")], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
        hits = decontaminate.contamination(docs, spark.createDataFrame([(5, f"{other} w x y z")], "item_id long, text string"))
        assert {r.doc_id: (r.n_hit, r.items) for r in hits.collect()} == {1: (0, []), 2: (5, ["5"]), 3: (0, [])}


def test_many_equal_rows_and_a_long_text(spark):
    """Equal rows are looked at once; a long text is one document."""
    import random

    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(600))
    long = " ".join(str(rng.random()) for _ in range(60_000))
    docs = spark.createDataFrame([(1, line)] * 1500 + [(2, long), (3, "x" + line[:300]), (4, long[-250:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(docs, keep_text=False).collect()}
    assert got == {1: (600, 1), 2: (250, 1), 3: (300, 1), 4: (250, 1)}
    n = len(long.encode())
    assert n > 10**6
    hits = decontaminate.judged(docs, spark.createDataFrame([(7, " ".join(long.split()[-8:]))], "item_id long, text string")).where("n_hit > 0").collect()
    assert {r.doc_id: r.items for r in hits} == {2: ["7"], 4: ["7"]}


def test_toxicity_folding_and_exceptions(spark):
    assert toxicity.fold("1D10T $cum ѕсum Ｌoser é-ê").split() == ["idiot", "scum", "scum", "loser", "e", "e"]
    m = toxicity.Matcher({" clown ": 2.0, " idi": 3.0, " idiot ": 1.0}, ["clown fish"])
    assert m.features("a clown fish")[0] == 0 and m.features("CL0WN")[0] > 0 and m.features("idiots idiot")[0] == pytest.approx(__import__("math").log1p(6.0))
    assert m.features(None) == m.features("") == (0.0, 0.0, 0.0)


def test_similar_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    signed = docs.select("doc_id", fingerprints.signatures(F.col("text")).alias("sigs")).collect()
    least = {}
    for r in signed:
        if r.sigs:
            key = tuple(r.sigs)
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    sets = {i: set(k) for k, i in least.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    for bound in (0.8, 0.3):
        got = {(r.a, r.b): r.likeness for r in fingerprints.similar_pairs(docs, bound).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= bound})
        assert got


def python_pii(corpus):
    """All spans of find_pii over (doc_id, text) rows without repeats, in plain Python: {doc_id: spans}."""
    import re

    from test_contracts import PII, valid

    word = re.compile(r"(?<![A-Za-z0-9@+._-])(?=(?:[A-Za-z@+._-]*[0-9]){3})[A-Za-z0-9@+._-]{6,}")

    def patterns(before):
        words = re.sub(r"\s*[:=(\"']*\s*$", "", before.lower()).split()
        return [f"{n} " + re.sub("[0-9]", "0", " ".join(words[-n:])) for n in (1, 2) if len(words) >= n and len(" ".join(words[-n:])) < 100]

    seen = []
    for i, t in corpus:
        base = [(m.start(), m.end(), k, m[0]) for k in PII for m in re.finditer(PII[k], t or "") if valid(k, m[0])]
        free = [(m.start(), m.end(), None, m[0]) for m in word.finditer(t or "") if not any(a < m.end() and m.start() < b for a, b, *_ in base)]
        seen += [(i, a, b, k, patterns(t[max(0, a - 120) : a]), of.lower()) for a, b, k, of in base + free]
    edges = Counter((p, of, k) for *_, k, ps, of in seen for p in ps)
    total, scores = Counter(), {}
    for (p, _, _), n in edges.items():
        total[p] += n
    for turn in range(3):
        trust = {}
        for p, of, k in edges if turn else ():
            for (q, kind), s in scores.items():
                if k is None and p == q and s >= 0.6:
                    trust[of, kind] = max(s, trust.get((of, kind), 0))
        gain, who = Counter(), {}
        for (p, of, k), n in edges.items():
            for kind in PII:
                s = 1.0 if k == kind else trust.get((of, kind), 0.0) if k is None else 0.0
                if s:
                    gain[p, kind] += n * s
                    who.setdefault((p, kind), set()).add(of)
        scores = {x: g / total[x[0]] for x, g in gain.items() if len(who[x]) >= 3}
    good = {}
    for (p, kind), s in scores.items():
        if s >= 0.6:
            good[p] = max(good.get(p, (0, "")), (s, kind))
    out = {i: [] for i, _ in corpus}
    for i, a, b, k, ps, _ in seen:
        best = max((good[p] for p in ps if p in good), default=None)
        if k or best:
            out[i].append((a, list(PII).index(k) if k else 4, b, k or f"context_{best[1]}"))
    return {i: sorted(x) for i, x in out.items()}


def test_patterns_discover_further_identifiers(spark):
    """By the words before, by the form, over earlier matches, and through identifiers found a turn before."""
    texts = [f"please call +1 (255) 555-80{i:02d} today" for i in range(10)] + ["please call 555-0199-3321 now", "item no 55x-0199-7777 now", None, ""]
    texts += [f"x 1.2.3.{k} ip 10.0.0.{k}" for k in range(10, 20)] + ["x 1.2.3.40 ip host-99177", "see 1.2.3.999, ip 10.0.0.1"]
    texts += [f"please call 555-0199-111{k} now" for k in range(5)] + [f"or reach me 555-0199-111{k} now" for k in range(5)] + ["or reach me 555-0199-2222 now", "or reach me zz-0a9b-2222 now"]
    rows = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: [(s.start, s.rank, s.stop, s.kind) for s in r.spans] for i, r in rows.items()} == python_pii(list(enumerate(texts)))
    assert [tuple(s) for s in rows[10].spans] == [(12, 4, 25, "context_phone")] and rows[11].spans == [] and rows[12].spans == []
    assert rows[len(texts) - 1].spans[0].kind == "context_phone" and rows[24].spans[-1].kind == "context_ip"


def test_spans_of_given_documents_and_hidden_seeds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id", "text"])
    got = {r.doc_id: [(s.start, s.rank, s.stop, s.kind) for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert got == python_pii([(r.doc_id, r.text) for r in docs.collect()])
    # personal data stand in random prose there, so words tell nothing: no number is marked by how it looks
    assert not any(r.wrong for r in pii.held_out_seeds(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect())


def test_hidden_identifiers_are_found_by_their_words(spark):
    """Recall of each kind, cards included, and nothing else marked: order numbers, dates, hashes and cards' look-alikes."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        x = digits(15)
        odd = sum(int(c) if k % 2 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(x))
        return x + str(-odd % 10)

    kinds = {"card": ("card no", card), "phone": ("call me at", lambda: f"+1 ({digits(3)}) 555-{digits(4)}"), "email": ("mail to", lambda: f"u{digits(4)}@mail{digits(2)}.example.com"), "ip": ("from host", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)))}
    others = {"order": lambda: digits(16), "on day": lambda: f"2024-{digits(2)}-{digits(2)}", "hash is": lambda: digits(9) + "af", "the": lambda: digits(16), "of the": card}
    rows = [f"{rng.choice(['so', 'then', 'we'])} {w} {make()} and so on" for w, make in [*kinds.values()] * 150 + [*others.items()] * 100]
    told = {r.kind: r for r in pii.held_out_seeds(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert {*kinds} < {*told} and all(told[k].found >= 0.9 * told[k].hidden > 0 for k in ("phone", "email", "ip")) and not any(r.wrong for r in told.values())
    spoken = pii.find_pii(spark.createDataFrame([(k, t) for k, t in enumerate([*rows, "so card no 1234567890123456x and", "so order 1234567890123456x and"])], "doc_id long, text string")).where("doc_id >= 1100").collect()
    assert sorted(len(r.spans) for r in spoken) == [0, 1] and told["card"].found >= 0.9 * told["card"].hidden


def test_personal_data_in_long_texts(spark):
    """Very many spans and very long runs; rows without id and repeated rows."""
    rows = [(1, "x a@b" + ".c" * 20_000), (2, "1.2.3.0," * 20_000), (None, "z" * 10**6 + " 1.1.1.1"), (3, None), (3, None), (4, "1.1.1.1"), (4, "1.1.1.1")]
    got = Counter((r.doc_id, len(r.base), len(r.spans)) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 1, 1): 1, (2, 20_000, 20_000): 1, (None, 1, 1): 1, (3, 0, 0): 2, (4, 1, 1): 2}


def test_pipeline(spark, sf, corpus):
    """Each stage against plain Python on what its predecessor kept; tables and null rows as they come."""
    import re

    from test_contracts import PLAIN, SECRETS, linked, low, shingle_sets, windows_of

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontaminate", "secrets", "mix"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(map(tuple, corpus_pipeline.drop_toxic(spark, docs, sf).collect()), key=str)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    assert rows == sorted((tuple(r)[:-1] for r in scored.collect() if r.score < 0.5), key=str)

    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    roots = linked(shingle_sets([(k, r[1]) for k, r in enumerate(corpus)]))
    groups = {}
    for k, r in enumerate(corpus):
        groups.setdefault(roots[k], []).append(r)
    want = {i for g in groups.values() for i in [min((r[0] for r in g if r[0] is not None), default=None)]}
    assert {r.doc_id for r in kept} == want and len(kept) == len(groups)

    windows = windows_of(map(tuple, spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    holds = lambda t: any(tuple(w[k : k + n]) in windows for w in [re.findall(PLAIN, low(t))] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf).collect()
    assert sorted(map(tuple, clean), key=str) == sorted((r for r in corpus if not holds(r[1])), key=str) and clean

    leaky = spark.createDataFrame([(1, "a token=abcdefgh AKIA" + "Q" * 16, "en", "s", 3), (2, "clean", "en", None, 5), (None, None, None, None, None)], docs.schema)
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, leaky, sf).collect()}
    assert masked[1].text == "a [SECRET] [SECRET]" and masked[1].n_chars == 19 and masked[2].text == "clean" and masked[None].text is None
    assert not any(re.search(p, r.text or "") and len(re.search(p, r.text)[g]) >= n for r in masked.values() for p, g, n in SECRETS.values())

    out = corpus_pipeline.run(spark, sf)
    assert {*docs.columns} < {*out.columns} and out.count() == out.select("doc_id").distinct().count() > 0
    assert corpus_pipeline.drop_contaminated(spark, out.select(docs.columns), sf).count() == out.count()


def test_pipeline_goes_on_after_a_failure(spark, sf, tmp_path, monkeypatch):
    folder, ran = str(tmp_path / "run"), []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return docs

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one"), stage("two"), stage("three", True)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one"), stage("two"), stage("three")])
    assert corpus_pipeline.run(spark, sf, folder).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert ran == ["one", "two", "three", "three"]


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (1, "a b c d e f", "z"), (2, "a b c d e f", "w"), (None, "g h i j k l", "v"), (None, "m", "u"), (None, "m", "t"), (3, None, "s"), (4, "", "r")]
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b c d e f"), (1, "g h i j k l"), (None, "m"), (3, None), (4, "")], key=str)


def test_op6_stretch_with_two_crowded_anchors_occurs_once(spark, monkeypatch):
    """A short line in many surroundings is no repeat, however many of its grams are crowded."""
    import random

    from test_contracts import repeats

    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    line, passage = say(190), say(230)
    texts = [say(300) + line + say(300) for _ in range(30)] + [say(250) + passage + say(250) for _ in range(30)]
    corpus = list(enumerate(texts))
    monkeypatch.setattr(suffix_dedup, "CROWD", 4)
    monkeypatch.setattr(suffix_dedup.blocks, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows = suffix_dedup.without_repeats(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = dict(zip([r[0] for r in corpus], repeats(corpus, 200), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_op4_bridged_clusters_are_joined(spark):
    """Two clusters of near copies and one pair just above 80 % between them, whose lists either cluster leads."""
    import numpy as np
    import pyarrow as pa

    bridges = range(12)
    both = {k: [f"s{k}x{i}" for i in range(89)] for k in bridges}
    sides = {(k, side): both[k] + [f"{side}{k}x{i}" for i in range(11)] for k in bridges for side in "pq"}
    lists = lambda texts: ngram_join.inverted_lists(spark.createDataFrame([(" ".join(t),) for t in texts], "text string"), np.zeros(0, np.uint64), 1, 80).collect()
    held = Counter(r.s for r in lists(sides.values()))  # in the listed parts of both sides
    words, hashes, texts = [w for k in bridges for w in both[k]], {}, []
    for i, _, values, ends in ngram_join._sets(pa.RecordBatch.from_pydict({"text": words}), 1):
        hashes |= {words[i + n]: int(values[ends[n]].view(np.int64)) for n in range(len(ends) - 1)}
    for k in bridges:
        listed = [w for w in both[k] if held[hashes[w]] == 2]
        half = {"p": set(listed[::2]), "q": set(listed[1::2])}
        for side in "pq":
            texts.append((k, sides[k, side]))
            texts += [(k, [w for w in sides[k, side] if w not in half[side]] + [f"{side}{k}copy{c}"]) for c in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs, words=1).collect()}
    assert got == {i: i // 14 * 14 for i in range(len(texts))}


def test_ledger_keeps_findings(spark, tmp_path):
    """Paths of blobs scanned before keep their findings, whatever a later run still has to scan."""
    docs = spark.createDataFrame([(1, "token=abcdefgh " + "0a" * 12), (2, "clean"), (3, "token=abcdefgh " + "0a" * 12), (4, "AKIA" + "Z" * 16)], "doc_id long, text string")
    whole = {r.doc_id: r.findings for r in secrets.find_secrets(docs).collect()}
    assert [len(whole[i]) for i in (1, 2, 3, 4)] == [2, 0, 2, 1]
    ledger = secrets.ledger_rows(secrets.scan_blobs(docs.where("doc_id < 3"))).cache()
    older = ledger.withColumn("version", F.when(F.col("rule") == "hex", 0).otherwise(F.col("version")))
    for known in (ledger, older, ledger.unionByName(ledger)):
        assert {r.doc_id: r.findings for r in secrets.find_secrets(docs, known).collect()} == whole
    path = str(tmp_path / "ledger")
    n = [secrets.through_ledger(d, path).count() for d in (docs.where("doc_id < 3"), docs, docs)]
    assert n == [2 * len(secrets.RULES), 3 * len(secrets.RULES), 3 * len(secrets.RULES)]
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert sorted(secrets.op10_secrets(spark, folder, path).collect()) == sorted(secrets.op10_secrets(spark, folder).collect())
