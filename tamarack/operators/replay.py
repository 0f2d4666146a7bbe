"""The visible part of stored transcripts: lost parents repaired, the active branch followed, both as joins.

A conversation may be of any length. What looks back ("the last record before this one that ...") works on
ranges of ORDS records whose ends are carried on; the branch is followed by pointer doubling: with the
links of 1, 2, 4 ... hops as tables, a handful of joins marks every record on the way from the last one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Record types that are no part of a conversation, and the one that names where a branch was left.
FORK = "resend-fork-notice"
CUSTOM = ("custom-title", "ai-title", "file-history-snapshot", "summary", "topic", "goal-result", "goal-progress", FORK)
#: Records that are looked at together.
ORDS = 10_000
#: What clients wrap around a user's words, and how summaries and their prompts began before records told them apart.
_WRAPPED = (r"<system-reminder[^>]*>[\s\S]*?</system-reminder>\s*", r"<image_local_path>[\s\S]*?</image_local_path>\s*")
_QUERY = r"<user_query>([\s\S]*?)</user_query>"
_REMINDER = r"""(?i)^<system-reminder\b[^>]*data-role=["']compact-summary["']"""
_PROMPTS = (
    r"(?i)^\s*<compact-request\b",
    r"(?i)^\s*Your task is to write a detailed and structured summary[\s\S]*<conversation_history_summary\b",
    r"(?i)^(?:\s|\*)*+Your ONLY output should be the\s+<conversation_history_summary>[\s\S]*<conversation_history_summary\b",
    r"(?i)^(?:\s|\*)*+Your task is to create a detailed summary of the conversation so far[\s\S]*<conversation_history_summary\b",
    r"(?i)^\s*Please continue with the conversation based on the summarized context above\b",
    r"(?i)^\s*Please\s+summarize\s+the\s+conversation\s+above[\s\S]*<(?:conversation_history_summary|cb_summary)\b",
)
_SUMMARY, _SUMMARY_OPENS, _SUMMARY_CLOSES = r"(?i)^\s*<conversation_history_summary\b", r"(?i)^\s*<cb_summary\b", r"(?i)</cb_summary>\s*$"
_SUMMARY_HOLDS = r"(?i)<previous_(?:tool_call|user_message|assistant_message)\b"
_TEAMMATE = r"(?is)^\s*<teammate-message\b[^>]*>.*</teammate-message>\s*$"
_FLAGS = ("compact", "teammate", "real_user", "custom", "notice")


def _of(path: str) -> Column:
    return F.get_json_object("value", f"$.{path}")


def _true(path: str) -> Column:
    return F.coalesce(_of(f"providerData.{path}") == "true", F.lit(False))


def _content(between: str, types: tuple[str, ...] = ()) -> Column:
    """A record's text: contentText, else content; a string, or the texts of its blocks (of these types, if any are named)."""

    def one(field: str) -> Column:
        blocks = F.from_json(_of(field), "array<struct<type:string,text:string>>")
        held = F.filter(blocks, lambda b: b["text"].isNotNull() & (b["type"].isin(*types) if types else F.lit(True)))
        return F.when(_of(f"{field}[0]").isNotNull(), F.array_join(F.transform(held, lambda b: b["text"]), between)).otherwise(F.nullif(_of(field), F.lit("[]")))

    return F.coalesce(one("contentText"), one("content"), F.lit(""))


def _is_teammate() -> Column:
    return _of("providerData.teammateMessage.from").isNotNull() | _content("").rlike(_TEAMMATE)


def _is_compact() -> Column:
    return _true("isCompactInternal") | _of("providerData.compactType").isNotNull()


def visible_text() -> Column:
    """What a transcript line (column value) shows of a user's or an assistant's words; empty for all that clients wrote themselves.

    Reminders and paths around a user's words are taken away; compactions, their prompts and summaries, notes between
    agents and meta records have no text.
    """
    body, blank = _content("\n", ("text", "input_text", "output_text")), r"^\s+|\s+$"
    typed = body
    for wrapped in _WRAPPED:
        typed = F.regexp_replace(typed, wrapped, "")
    user = F.coalesce(_of("role") == "user", F.lit(False))
    shown = F.when(user, F.regexp_replace(F.regexp_replace(typed, _QUERY, "$1"), blank, "")).otherwise(body)
    plain = F.regexp_replace(shown, blank, "")
    prompt, summary = F.lit(False), body.rlike(_SUMMARY) | (body.rlike(_SUMMARY_OPENS) & body.rlike(_SUMMARY_CLOSES) & body.rlike(_SUMMARY_HOLDS))
    for pattern in _PROMPTS:
        prompt = prompt | plain.rlike(pattern)
    said = F.coalesce((_of("type") == "message") & _of("role").isin("user", "assistant"), F.lit(False))
    hidden = (user & _true("isMeta")) | _is_compact() | F.regexp_replace(body, blank, "").rlike(_REMINDER) | F.when(user, prompt).otherwise(summary) | _is_teammate()
    return F.when(~said | (plain == "") | hidden, F.lit("")).otherwise(shown)


def records(lines: DataFrame) -> DataFrame:
    """(conv, ord, id, parent, logical, type and flags) of transcript lines (conv, ord, value): JSON objects.

    compact: a user's message that a compaction wrote; teammate: a note between agents; real_user: a message
    that the user typed; custom: no part of the conversation; notice: says that a filter cut the history.
    """
    of, true = _of, _true
    told = lambda path: F.nullif(F.trim(of(path)), F.lit(""))
    client = F.from_json(of("providerData.clientMeta"), "map<string,string>")
    steer = F.coalesce(F.exists(F.map_values(client), lambda x: F.coalesce(F.get_json_object(x, "$.queueOrigin"), F.lit("")) == "steer"), F.lit(False))
    message, user = F.coalesce(of("type") == "message", F.lit(False)), F.coalesce(of("role") == "user", F.lit(False))
    told_compact, teammate = _is_compact(), _is_teammate()
    own = lines.select("conv", "ord", told("id").alias("id"), told("parentId").alias("parent"), told("logicalParentId").alias("logical"), of("type").alias("type"), message.alias("m"), user.alias("u"), told_compact.alias("c"), teammate.alias("teammate"), (true("skipRun") | true("isMeta") | steer).alias("aside"), true("contentFilterNotice").alias("notice"))
    return own.select("conv", "ord", "id", "parent", "logical", "type", (F.col("m") & F.col("u") & F.col("c")).alias("compact"), "teammate", F.expr("m AND u AND NOT c AND NOT aside AND NOT teammate").alias("real_user"), F.coalesce(F.col("type").isin(*CUSTOM), F.lit(False)).alias("custom"), "notice")


def last_before(rows: DataFrame, where: Column, value: Column, name: str, ords: int = ORDS) -> DataFrame:
    """rows and `name`: value of the last row of the same conv, by ord, before each that where holds for."""
    rows = rows.withColumns({"_at": F.expr(f"ord div {ords}"), "_value": F.when(where, F.struct("ord", value.alias("v")))})
    ends = rows.groupBy("conv", "_at").agg(F.max("_value").alias("_end"))
    back = Window.partitionBy("conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(back)).drop("_end")
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy("conv", "_at").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", own).join(ends, ["conv", "_at"]).withColumn(name, F.coalesce("_own", "_carried")["v"]).drop("_at", "_value", "_own", "_carried")


def _tangled(items: DataFrame) -> DataFrame:
    """(conv): where a record to be repaired stands and links do not all lead back: a parent comes later, or an id stands in several places."""
    fixable = items.where("id IS NOT NULL AND logical IS NULL AND (compact OR teammate)").select("conv").distinct()
    nodes = items.where("id IS NOT NULL").groupBy("conv", "id").agg(F.max("ord").alias("last"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    parents = nodes.select("conv", F.col("id").alias("parent"), F.col("last").alias("parent_last"))
    ahead = items.where("id IS NOT NULL").join(parents, ["conv", "parent"]).where("parent_last > ord AND parent <> id").select("conv")
    return fixable.join(ahead.unionByName(nodes.where("last - first >= n").select("conv")).distinct(), "conv", "left_semi")


def _repair(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tangled conversation: record after record, as each repair changes what the next one sees."""
    pdf = pdf.sort_values("ord")
    rows = [dict(zip(pdf.columns, x, strict=True)) for x in pdf.itertuples(index=False)]
    last = {r["id"]: r for r in rows if r["id"] is not None}

    def leads(start: str | None, to: str) -> bool:
        seen = set()
        while start is not None and start not in seen:
            if start == to:
                return True
            seen.add(start)
            start = last[start]["parent"] if start in last else None
        return False

    for i, r in enumerate(rows):
        if r["id"] is None or r["logical"] is not None or not (r["compact"] or r["teammate"]):
            continue
        broken = r["parent"] is None or r["parent"] == r["id"] or r["parent"] not in last
        if broken or (r["compact"] and leads(r["parent"], r["id"])):
            before = (x["id"] for x in reversed(rows[:i]) if x["id"] not in (None, r["id"]) and not x["custom"] and not leads(x["id"], r["id"]))
            if (found := next(before, None)) is not None:
                r["parent"], r["logical"] = (None, found) if r["compact"] else (found, None)
    return pd.DataFrame({c: [r[c] for r in rows] for c in ("conv", "ord", "parent", "logical")}, dtype=object).astype({"ord": "int64"})


def repaired(items: DataFrame, ords: int = ORDS) -> DataFrame:
    """items with parents that were lost: of compactions (as logical parent) and of notes without a known parent, that is the record before.

    Where all links lead back the record before is a look back over ranges. In a tangled conversation, whose links also lead
    forward, a repair must not close a circle; that is decided record by record in one group, for those conversations only.
    """
    tangled = _tangled(items)
    plain = items.join(tangled, "conv", "left_anti")
    eligible = F.col("id").isNotNull() & ~F.col("custom")
    plain = last_before(plain, eligible, F.col("id"), "_one", ords)
    # of a run of records with equal ids, what stands before the run
    plain = last_before(plain, eligible & F.expr("NOT (_one <=> id)"), F.col("_one"), "_two", ords)
    before = F.when(F.expr("_one <> id"), F.col("_one")).otherwise(F.col("_two"))
    ids = items.where("id IS NOT NULL").select("conv", F.col("id").alias("parent"), F.lit(True).alias("_known")).distinct()
    plain = plain.join(ids, ["conv", "parent"], "left")
    fix = F.expr("id IS NOT NULL AND logical IS NULL AND (compact OR teammate) AND (parent IS NULL OR parent = id OR _known IS NULL)") & before.isNotNull()
    plain = plain.select(
        *[F.col(c) for c in items.columns if c not in ("parent", "logical")],
        F.when(fix & F.col("compact"), None).when(fix, before).otherwise(F.col("parent")).alias("parent"), F.when(fix & F.col("compact"), before).otherwise(F.col("logical")).alias("logical"),
    )
    knots = items.join(tangled, "conv", "left_semi")
    fixed = knots.select("conv", "ord", "id", "parent", "logical", "compact", "teammate", "custom").groupBy("conv").applyInPandas(_repair, "conv string, ord long, parent string, logical string")
    return plain.unionByName(knots.drop("parent", "logical").join(fixed, ["conv", "ord"]))


def _runs(items: DataFrame, ords: int) -> tuple[DataFrame, DataFrame]:
    """items with `run` (ord of the first of neighbours with one id), and (conv, run, id, last, target) of each run: the id that its first record leads back to."""
    items = last_before(items, F.lit(True), F.struct("id"), "_before", ords)
    items = items.withColumn("_opens", F.expr("id IS NOT NULL AND NOT (_before.id <=> id)"))
    gap = F.expr(f"(custom AND NOT (type <=> '{FORK}')) OR teammate")
    items = last_before(items, ~gap, F.struct("type", "parent"), "_said", ords)
    items = last_before(items, F.col("_opens"), F.col("ord"), "_run", ords)
    items = items.withColumn("run", F.when(F.col("_opens"), F.col("ord")).when(F.col("id").isNotNull(), F.col("_run")))
    target = F.when(F.expr(f"real_user AND _said.type <=> '{FORK}'"), F.col("_said.parent")).otherwise(F.coalesce("parent", "logical"))
    ends = items.where("run IS NOT NULL").groupBy("conv", "run").agg(F.max("ord").alias("last"))
    heads = items.where("_opens").select("conv", "run", "id", target.alias("target"))
    return items.drop("_before", "_opens", "_said", "_run"), heads.join(ends, ["conv", "run"])


def _links(runs: DataFrame) -> DataFrame:
    """(conv, a, b): from run a to the last run before it that has its target's id."""
    asks = runs.where("target IS NOT NULL").select("conv", F.col("target").alias("id"), F.col("run").alias("at"), F.col("run").alias("a"), F.lit(None).cast("long").alias("b"))
    have = runs.select("conv", "id", F.col("last").alias("at"), F.lit(None).cast("long").alias("a"), F.col("run").alias("b"))
    line = Window.partitionBy("conv", "id").orderBy("at", F.col("a").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a run that asks for its own id asks from its first record on, and ends there at the earliest
    both = asks.unionByName(have).withColumn("b", F.last(F.when(F.col("b").isNotNull(), F.struct("at", "b")), ignorenulls=True).over(line))
    own = both.where("a IS NOT NULL AND b IS NOT NULL")
    return own.where("b.b < a").select("conv", "a", F.col("b.b").alias("b")).unionByName(_own_again(runs, own.where("b.b >= a").select("conv", "a")))


def _own_again(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, a, b) for single records that lead to their own id: the run before with that id."""
    before = F.lag("run").over(Window.partitionBy("conv", "id").orderBy("run"))
    rows = runs.withColumn("b", before).select("conv", F.col("run").alias("a"), "b").where("b IS NOT NULL")
    return rows.join(wanted, ["conv", "a"], "left_semi")


def active(items: DataFrame, ords: int = ORDS, keep=None) -> DataFrame:
    """(conv, ord) of the records on show, of `records`.

    All that are not custom, unless a filter's notice, a fork's notice or two typed messages with one parent
    say that there are branches: then those on the way back from the last record that has an id. keep: how to store a table
    that is read several times, by default a checkpoint, or a cached table where there is no folder for one.
    """
    keep = keep or _kept
    items = keep(repaired(items, ords))
    twins = items.where("real_user AND parent IS NOT NULL").groupBy("conv", "parent").count().where("count > 1").select("conv")
    branched = items.where(F.col("notice") | F.coalesce(F.col("type") == FORK, F.lit(False))).select("conv").unionByName(twins).distinct()
    whole = items.join(branched, "conv", "left_anti").where("NOT custom").select("conv", "ord")
    rows, runs = _runs(items.join(branched, "conv", "left_semi"), ords)
    rows, runs = keep(rows), keep(runs)
    most = runs.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    hops = [keep(_links(runs))]
    while 1 << len(hops) < most:
        far = hops[-1]
        hops.append(keep(far.join(far.select("conv", F.col("a").alias("b"), F.col("b").alias("c")), ["conv", "b"]).select("conv", "a", F.col("c").alias("b"))))
    last = rows.where("id IS NOT NULL AND NOT custom").groupBy("conv").agg(F.max(F.struct("ord", "id")).alias("x")).select("conv", "x.id")
    met = runs.join(last, ["conv", "id"]).groupBy("conv").agg(F.max("run").alias("run"))
    for hop in reversed(hops):
        met = keep(met.unionByName(met.join(hop, [hop["conv"] == met["conv"], hop["a"] == met["run"]]).select(met["conv"], F.col("b").alias("run"))).distinct())
    return whole.unionByName(rows.where("NOT custom").join(met, ["conv", "run"], "left_semi").select("conv", "ord"))


def _kept(df: DataFrame) -> DataFrame:
    from .catalog import _kept as kept

    return kept(df)
