"""Conversation topics: text from messages, literal search, excerpts, relevance, upkeep."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import names
from . import replay


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFC")


def fold(x: Column, normalize: bool = True) -> Column:
    """NFC, then lower case of all scripts. Python gets only texts above ASCII, null for the others."""
    if not normalize:
        return F.lower(x)
    return F.lower(F.coalesce(_nfc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x))


def terms(query: str) -> list[str]:
    """Distinct folded terms, ascending."""
    return sorted(set(unicodedata.normalize("NFC", query).lower().split()))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, messages) of conversations (conv_id, turn, role, text).

    User and assistant turns are messages; the title is the first user text's 120 characters, also kept
    as a message of key `meta`; provider, time and archive flag follow from conv_id.
    """
    said = conversations.where("role IN ('user', 'assistant')").select(F.col("conv_id").cast("string").alias("topic_id"), F.col("turn").alias("msg_key"), "role", F.coalesce("text", F.lit("")).alias("body"), "conv_id")
    first = F.min_by(F.when(F.col("role") == "user", F.col("body")), F.when(F.col("role") == "user", F.col("msg_key")))
    title = F.replace(F.substring(F.coalesce(first, F.lit("")), 1, 120), F.lit("\n"), F.lit(" "))
    topics = said.groupBy("topic_id", "conv_id").agg(title.alias("title"), F.count(F.lit(1)).alias("messages"))
    provider = F.element_at(F.array(F.lit("north"), F.lit("south"), F.lit("west")), (F.col("conv_id") % 3 + 1).cast("int"))
    topics = topics.select("topic_id", "title", provider.alias("provider"), (F.lit(1704067200) + F.col("conv_id") * 3600).alias("modified"), (F.col("conv_id") % 11 == 0).alias("archived"), "messages")
    meta = topics.select("topic_id", F.lit(-1).cast("long").alias("msg_key"), F.col("title").alias("body"))
    return topics, said.select("topic_id", "msg_key", "body").unionByName(meta)


def matching(messages: DataFrame, query: str, normalize: bool = True) -> DataFrame:
    """topic_id of topics where every term stands in some message."""
    wanted = terms(query)
    rows = messages.select("topic_id", fold(F.col("body"), normalize).alias("f"))
    rows = rows.where(reduce(Column.__or__, [F.col("f").contains(t) for t in wanted])) if wanted else rows
    hits = rows.groupBy("topic_id").agg(*[F.max(F.col("f").contains(t)).alias(f"t{i}") for i, t in enumerate(wanted)] or [F.lit(True).alias("t0")])
    return hits.where(reduce(Column.__and__, [F.col(f"t{i}") for i in range(max(1, len(wanted)))])).select("topic_id")


def search(topics: DataFrame, messages: DataFrame, query: str, providers: list[str] | None = None, limit: int = 200, normalize: bool = True) -> DataFrame:
    """The latest `limit` topics that match, archived ones left out; has_more says whether others match too."""
    live = topics.where("NOT archived")
    live = live.where(F.col("provider").isin(providers)) if providers else live
    hits = live.join(matching(messages, query, normalize), "topic_id", "left_semi") if terms(query) else live
    rows = hits.orderBy(F.desc("modified"), "topic_id").limit(limit + 1)
    more = rows.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return rows.orderBy(F.desc("modified"), "topic_id").limit(limit).join(F.broadcast(more))  # one row


def grams(texts: DataFrame, folded: str) -> DataFrame:
    """texts and `grams`: distinct characters, pairs, and triples of ASCII characters of a text; rows without a text go.

    Each text is cut into characters once: finding the nth one anew for every gram would cost the square of its length.
    """
    both = lambda a, b: F.concat(a, b)
    rest = lambda x, start: F.slice(x, F.lit(start), F.size("_chars"))
    least = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    rows = texts.where(F.col(folded) != "").withColumn("_chars", F.split(folded, ""))
    rows = rows.withColumn("_pairs", F.zip_with(least(F.col("_chars")), rest("_chars", 2), both))
    triples = F.filter(F.zip_with(least(F.col("_pairs")), rest("_chars", 3), both), lambda g: F.octet_length(g) == 3)
    return rows.withColumn("grams", F.array_distinct(F.concat("_chars", "_pairs", triples))).drop("_chars", "_pairs")


def query_grams(term: str) -> list[str]:
    """What postings of a term to intersect: its character, its pairs, or its ASCII triples."""
    n = 1 if len(term) == 1 else 3 if len(term) >= 3 and term.isascii() else 2
    return sorted({term[i : i + n] for i in range(len(term) - n + 1)})


def postings(messages: DataFrame, normalize: bool = True) -> DataFrame:
    """(gram, topic_id), for an index kept by gram."""
    folded = messages.select("topic_id", fold(F.col("body"), normalize).alias("f"))
    # explode would add a filter on the size of `grams`, which computes them a second time; no row here has none
    return grams(folded, "f").select("topic_id", F.explode_outer("grams").alias("gram")).distinct()


def candidates(index: DataFrame, query: str) -> DataFrame:
    """topic_id of topics that hold every gram of the query; a superset of what matches."""
    wanted = sorted({g for t in terms(query) for g in query_grams(t)})
    hits = index.where(F.col("gram").isin(wanted)).groupBy("topic_id").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("topic_id")


def excerpts(messages: DataFrame, query: str, normalize: bool = True) -> DataFrame:
    """(topic_id, excerpt): 220 characters around the first term, from a message rather than the title, the earliest one."""
    term = terms(query)[0]
    rows = messages.withColumn("f", fold(F.col("body"), normalize)).where(F.col("f").contains(term))
    best = rows.groupBy("topic_id").agg(F.min(F.struct((F.col("msg_key") < 0).alias("meta"), "msg_key", "body", F.instr("f", term).alias("at"))).alias("m"))
    return best.select("topic_id", F.substring(F.col("m.body"), F.greatest(F.lit(1), F.col("m.at") - 45), F.lit(220)).alias("excerpt"))


def relevance(topics: DataFrame, query: str, now: int, normalize: bool = True) -> DataFrame:
    """topics and score: per term 1000 the title, 800 its beginning, 600 in it, else 250; mean, less length, plus recency."""
    wanted = terms(query)
    if not wanted:
        return topics.withColumn("score", F.lit(0))
    title = fold(F.col("title"), normalize)
    each = [F.when(title == t, 1000).when(title.startswith(t), 800).when(title.contains(t), 600).otherwise(250) for t in wanted]
    mean = F.floor(reduce(Column.__add__, each) / len(wanted)).cast("int")
    rest = F.least(F.greatest(F.octet_length(title) - sum(len(t.encode()) for t in wanted), F.lit(0)), F.lit(64))
    return topics.withColumn("score", mean - 2 * rest + 60 + names.recency("modified", now))


def upserted(topics: DataFrame, updates: DataFrame) -> DataFrame:
    """updates and `op`: what an upsert by topic_id does; rows that would change no column are left out.

    All columns of updates that topics has, too, are compared, null being a value like others.
    """
    both = [c for c in updates.columns if c in topics.columns and c != "topic_id"]
    old = topics.select("topic_id", F.struct(F.lit(True).alias("known"), *[F.col(c) for c in both]).alias("_old"))
    same = F.lit(True)
    for c in both:
        same = same & F.col(c).eqNullSafe(F.col("_old")[c])
    at = updates.join(old, "topic_id", "left")
    op = F.when(F.col("_old").isNull(), "insert").when(~same, "update")
    return at.withColumn("op", op).where("op IS NOT NULL").select(*updates.columns, "op")


def title_messages(topics: DataFrame, key: str = "meta") -> DataFrame:
    """(topic_id, msg_key, body): a topic's title and project as a message, by which it is found, too."""
    return topics.select("topic_id", F.lit(key).alias("msg_key"), F.concat(F.col("title"), F.lit("\n"), F.coalesce("project", F.lit(""))).alias("body"))


def message_changes(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """(topic_id, msg_key, op): empty bodies delete, equal ones change nothing."""
    old = messages.select("topic_id", "msg_key", F.col("body").alias("old"))
    at = updates.join(old, ["topic_id", "msg_key"], "left")
    op = (
        F.when((F.col("body") == "") & F.col("old").isNotNull(), "delete")
        .when((F.col("body") != "") & F.col("old").isNull(), "insert")
        .when((F.col("body") != "") & (F.col("body") != F.col("old")), "update")
    )
    return at.withColumn("op", op).where("op IS NOT NULL").select("topic_id", "msg_key", "op")


def vanished(messages: DataFrame, live: DataFrame) -> DataFrame:
    """Messages whose (topic_id, msg_key) is no longer in the source."""
    return messages.join(live, ["topic_id", "msg_key"], "left_anti")


def thread_summary(messages: DataFrame) -> DataFrame:
    """(topic_id, items, last): how far each thread has been read."""
    return messages.where("msg_key >= 0").groupBy("topic_id").agg(F.count(F.lit(1)).alias("items"), F.max("msg_key").alias("last"))


def seconds(x: Column) -> Column:
    """Times given in seconds, milliseconds (above 1e11) or as ISO text, as seconds."""
    number = x.try_cast("double")
    return F.when(number > 1e11, number / 1000).otherwise(F.coalesce(number, F.unix_timestamp(F.try_to_timestamp(x)).cast("double")))


def active_branch(messages: DataFrame) -> DataFrame:
    """(conv, id, ord) on the branch that ends at each conversation's last message.

    messages: conv, id, parent, ord. Where no two messages share a parent all of them stay; else the
    links back from the last one are followed. Whole transcripts, with their notices and repairs, are in `replay`.
    """
    no = F.lit(False)
    rows = messages.select("conv", "ord", "id", "parent", F.lit(None).cast("string").alias("logical"), F.lit("message").alias("type"), no.alias("compact"), no.alias("teammate"), F.lit(True).alias("real_user"), no.alias("custom"), no.alias("notice"))
    return messages.join(replay.active(rows), ["conv", "ord"], "left_semi").select("conv", "id", "ord")


def visible_text(kind: Column, meta: Column, content: Column) -> Column:
    """Text of a transcript record: a string, or the texts of an array of {type, text} blocks; meta records have none."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"])
    text = F.when(content.startswith("[{"), F.array_join(texts, "\n")).otherwise(content)
    return F.when(kind.isin("user", "assistant") & ~F.coalesce(meta, F.lit(False)), text)
