import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, odd texts, nulls and a repeated row."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "der", "la", "été", "x😀y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(1, 120)) for _ in range(60)]
    passage = say(60)
    texts = list(base)
    texts += [base[0]] * 5 + [base[1].upper()]
    for k in range(2, 12):
        w = base[k].split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(6)]
    texts += ["", " \t\n", "a", "a b c d", "A B C D", "word " * 3000, "x" * 5000, "é" * 900, passage, " ".join(["u"] * 7), "line\n" * 120]
    rows = [(3 * i, t, "en", f"s{rng.randrange(4) if rng.random() < 0.6 else 0}", len(t)) for i, t in enumerate(texts)]
    return [*rows, (1000, None, None, None, None), (1001, None, "en", "", 0), (1003, passage, "en", "s1", 5), (1003, passage, "en", "s1", 5)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, corpus, tmp_path_factory):
    """The corpus and its side tables as a folder that queries can read."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(i, t[:200]) for i, (_, t, *_) in enumerate(corpus) if t and i % 9 == 0] + [(900, None), (901, ""), (902, "w1 w2"), (903, "w1 w2"), (None, "w3 w4 w5")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, int("w7" in (r[1] or "").split())) for r in corpus if r[0] % 2 == 0] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
