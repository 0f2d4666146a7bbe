"""Headline searches over the catalog built from $BENCH_SF_DIR; prints one JSON line.

The same searches run again, as `large_*`, over a catalog of LARGE rows: copies of the given one's rows under
ids and names of their own. `large_per_million` is the seconds that a search takes per million rows, `large_rows`
how many there are.

The catalog is built and kept in memory first (`build`), as an index would be; each search is the best of
three runs that fetch its results.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import search, topics
from tamarack.plans import adapters
from tamarack.plans.adapters import NOW

SEARCHES = {
    "letter": "d", "word": "doc-1", "two_words": "doc 7", "glob": "*.pdf", "ext": "ext:png", "kind": "kind:image", "path": "src1/", "not_folder": "doc !node_modules",
    "or_size": "png|zip size:>1mb", "dated": "dm:7d ext:md", "regex": r"regex:^my_doc\d+5\.", "recent": "",
}


LARGE = 850_000
BEST = 200  # results fetched by each search


def enlarged(catalog: DataFrame, rows: int) -> DataFrame:
    """Rows of a catalog repeated until there are as many, each copy with an id and a name of its own."""
    copies = -(-rows // catalog.count())
    more = catalog.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    stem = F.concat(F.lit("c"), F.col("copy").cast("string"), F.lit("_"))
    told = {c: F.when(F.col("copy") > 0, F.concat(stem, F.col(c))).otherwise(F.col(c)) for c in ("name", "folded")}
    return more.withColumns({"entry_id": F.col("entry_id") + F.col("copy").cast("long") * (1 << 32), **told}).drop("copy")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name: str, run, times: int = 3) -> None:
        best = float("inf")
        for _ in range(times):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)

    catalog = adapters.catalog(spark, sf_dir).coalesce(int(cpus)).cache()
    timed("build", catalog.count, 1)
    for name, line in SEARCHES.items():
        timed(name, lambda line=line: search.search(catalog, line, search.Options(now=NOW), BEST).collect())
    timed("sort_name", lambda: search.search(catalog, "doc", search.Options(sort="name", ascending=True, now=NOW), BEST).collect())
    narrowed = search.found(catalog, "doc-1", search.Options(now=NOW)).drop("score").cache()
    narrowed.count()
    timed("narrowed", lambda: search.search(narrowed, "doc-12", search.Options(now=NOW), BEST).collect())
    han = adapters.han(spark, sf_dir).coalesce(int(cpus)).cache()
    han.count()
    timed("syllables", lambda: search.search(han, "wd", search.Options(now=NOW), BEST).collect())
    heads, messages = (x.cache() for x in adapters.topics(spark, sf_dir))
    timed("topics_build", lambda: (heads.count(), messages.count()), 1)
    timed("topics", lambda: topics.search(heads, messages, "the ing").collect())
    headline = round(sum(took.values()), 3)
    large = enlarged(catalog, LARGE).repartition(int(cpus)).cache()
    rows = large.count()
    for name, line in SEARCHES.items():
        timed(f"large_{name}", lambda line=line: search.search(large, line, search.Options(now=NOW), BEST).collect())
    spent = sum(took[f"large_{name}"] for name in SEARCHES)
    took["large_per_million"] = round(spent / (rows * len(SEARCHES)) * 1e6, 4)
    print(json.dumps({"metric": "search_total", "value": headline, "unit": "sec", "queries": took, "large_rows": rows, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
