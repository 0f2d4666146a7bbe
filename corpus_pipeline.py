"""A corpus cleaned in five stages, each written as Parquet and read again as the next one's documents.

    toxicity       documents scored 0.5 or more go
    near_copies    of each group of linked documents the one with the least doc_id stays
    decontaminate  documents that hold a window of a benchmark item go
    secrets        spans of secrets are replaced by a mask; the document stays
    mix            every document gets its slot in a mix of sources
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontaminate, mixing, ngram_join, secrets, storage, toxicity

#: Learned weights and exact whole-text set joins are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Other columns travel in a struct, so their names cannot clash with score."""
    columns, docs = docs.columns, storage.packed(docs, ["doc_id", "text"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    return storage.unpacked(toxicity.score(docs, toxicity.learn(docs, labels)).where("score < 0.5"), columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays; rows of one doc_id with different texts are different documents."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where there is one, follows the masked text."""
    columns, docs = docs.columns, storage.packed(docs, ["doc_id", "text", "n_chars"])
    found = secrets.find_secrets(docs).withColumn("text", secrets.redacted(F.col("text"), F.col("findings")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return storage.unpacked(found, columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows: the columns of documents and those of the mix.

    Stages are written below folder, by default a new one in the shared folder. Given the folder of a run
    that failed, stages that it completed are read instead of being run again. A stage's table goes once the
    next one is written; the last one stays, because the result reads it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = folder or f"{storage.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = [k for k, (name, _) in enumerate(STAGES) if storage.exists(spark, f"{folder}/{name}/_SUCCESS")]
    if done:
        last = f"{folder}/{STAGES[done[-1]][0]}"
        docs = spark.read.parquet(last)
    for name, stage in STAGES[done[-1] + 1 if done else 0 :]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if last:
            storage.remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
