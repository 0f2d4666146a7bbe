"""Entries, topics and changes derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalog as catalog_ops
from ..operators import topics as topic_ops

NOW = 1706745600  # 2024-02-01T00:00:00Z

ENTRIES_SQL = """
WITH d AS (
  SELECT doc_id, n_chars, lang, CAST(substring(source, 4) AS INT) AS s,
         CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS l,
         CASE source WHEN 'src7' THEN 'node_modules' WHEN 'src9' THEN 'src9.app'
              WHEN 'src11' THEN 'src11.PhotosLibrary' WHEN 'src13' THEN 'src13.xcworkspace' ELSE source END AS top,
         CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'md' WHEN 1 THEN 'TXT' WHEN 2 THEN 'pdf' WHEN 3 THEN 'png'
              WHEN 4 THEN 'swift' WHEN 5 THEN 'zip' WHEN 6 THEN 'mp4' ELSE 'xyz' END AS ext
  FROM {documents})
SELECT CAST(1 + s AS BIGINT) AS entry_id, CAST(0 AS BIGINT) AS parent_id, top AS name, TRUE AS is_dir,
       CAST(0 AS BIGINT) AS size, CAST(1704067200 AS BIGINT) AS mtime FROM (SELECT DISTINCT s, top FROM d) a
UNION ALL
SELECT CAST(1000 + 10 * s + l AS BIGINT), CAST(1 + s AS BIGINT), lang, TRUE, CAST(0 AS BIGINT), CAST(1704067200 AS BIGINT)
FROM (SELECT DISTINCT s, l, lang FROM d) b
UNION ALL
SELECT CAST(100000 + doc_id AS BIGINT), CAST(1000 + 10 * s + l AS BIGINT),
       concat(CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'Doc-' ELSE 'my_doc' END,
              CAST(doc_id AS STRING), '.', ext),
       FALSE, CAST(n_chars * 1000 AS BIGINT), CAST(1704067200 + (doc_id % 40) * 86400 AS BIGINT) FROM d
"""

#: A second source: parts as files of one folder, names with blanks and digits.
PARTS_SQL = """
SELECT CAST(1 AS BIGINT) AS entry_id, CAST(0 AS BIGINT) AS parent_id, 'parts' AS name, TRUE AS is_dir,
       CAST(0 AS BIGINT) AS size, CAST(1704067200 AS BIGINT) AS mtime FROM (SELECT count(*) AS n FROM {part}) a
UNION ALL
SELECT CAST(10 + p_partkey AS BIGINT), CAST(1 AS BIGINT), concat(p_name, ' ', CAST(p_partkey AS STRING), '.log'), FALSE,
       CAST(p_size * 100000 AS BIGINT), CAST(1704067200 + (p_partkey % 30) * 86400 AS BIGINT) FROM {part}
"""

#: Some characters, of which names in HAN_SQL begin with two.
HAN = "文档项目备份中国人小上下天山水火木金土日月年学生书包图报告同会议计表格新旧女张王李"
#: The first source again, its files under names that begin with Han characters.
HAN_SQL = f"""
SELECT entry_id, parent_id, CASE WHEN is_dir THEN name ELSE concat(substring('{HAN}', CAST(entry_id % {len(HAN)} AS INT) + 1, 1),
  substring('{HAN}', CAST((entry_id * 7 + entry_id % 61) % {len(HAN)} AS INT) + 1, 1), name) END AS name, is_dir, size, mtime
FROM (SELECT * FROM ({ENTRIES_SQL}) x) e
"""

#: Files as a change feed saw them last: one row a path of the documents catalog, or a new one.
SEEN_SQL = """
SELECT concat('/src', CAST(user_id % 20 AS STRING), '/en/my_doc', CAST(user_id AS STRING), '.TXT') AS path, event_id,
       CAST(event_id % 4 AS INT) AS flags, event_type <> 'error' AS present, CAST(floor(value * 100) AS BIGINT) AS size,
       CAST(1704067200 + event_id AS BIGINT) AS mtime FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRIES_SQL, documents=table(spark, sf_dir, "documents"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a catalog: source folders, language folders, files."""
    return catalog_ops.build(entries(spark, sf_dir))


def han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.build(spark.sql(HAN_SQL, documents=table(spark, sf_dir, "documents")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.build(spark.sql(PARTS_SQL, part=table(spark, sf_dir, "part")))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEEN_SQL, events=table(spark, sf_dir, "events"))


def topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return topic_ops.from_conversations(table(spark, sf_dir, "conversations"))
