"""Visible records of transcripts: worked examples, and random knots against the rules taken one after the other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import replay

NAMES = "conv string, ord long, id string, parent string, logical string, type string, compact boolean, teammate boolean, real_user boolean, custom boolean, notice boolean"


def message(id, parent=None, role="user", **provider):
    return {"type": "message", "id": id, "role": role, "content": id} | ({"parentId": parent} if parent else {}) | ({"providerData": provider} if provider else {})


EXAMPLES = [
    (
        [
            message("root"), message("root-reply", "root", "assistant"), message("old-user", "root-reply"), message("old-reply", "old-user", "assistant"), {"type": "custom-title", "id": "title"},
            {"type": "resend-fork-notice", "id": "fork", "parentId": "root-reply"}, message("edited-user", "old-reply"), message("edited-reply", "edited-user", "assistant"),
        ],
        {0, 1, 6, 7},
    ),
    ([message("discarded"), message("root"), message("answer", "root", "assistant"), message("answer", "root", "assistant", contentFilterNotice=True)], {1, 2, 3}),
    (
        [
            message("root"), message("answer", "compact", "assistant"), message("compact", "answer", isCompactInternal=True),
            {"type": "message", "id": "teammate", "role": "user", "content": '<teammate-message from="worker">internal note</teammate-message>'}, message("latest", "teammate", contentFilterNotice=True),
        ],
        {0, 2, 3, 4},
    ),
    ([message("a"), message("b", "a", "assistant"), {"type": "summary", "id": "s"}], {0, 1}),
    ([message("a"), message("b", "a"), message("c", "a")], {0, 2}),
    ([message("a"), message("b", "a"), message("c", "a", clientMeta={"x.y": {"queueOrigin": "steer"}})], {0, 1, 2}),
    ([{"type": "resend-fork-notice"}, {"type": "message", "role": "user"}], set()),
]


def test_worked_examples(spark):
    lines = [(f"c{c}", k, json.dumps(x)) for c, (rows, _) in enumerate(EXAMPLES) for k, x in enumerate(rows)]
    shown = replay.active(replay.records(spark.createDataFrame(lines, "conv string, ord long, value string")), ords=3).collect()
    assert {(r.conv, r.ord) for r in shown} == {(f"c{c}", k) for c, (_, want) in enumerate(EXAMPLES) for k in want}


def plain(rows):
    """The rules for one conversation, rows as dicts in order."""
    rows = [dict(r) for r in rows]
    last = {r["id"]: k for k, r in enumerate(rows) if r["id"]}

    def leads(at, to):
        seen = set()
        while at and at not in seen:
            if at == to:
                return True
            seen.add(at)
            at = rows[last[at]]["parent"] if at in last else None
        return False

    for k, r in enumerate(rows):
        if r["id"] and not r["logical"] and (r["compact"] or r["teammate"]):
            if not r["parent"] or r["parent"] == r["id"] or r["parent"] not in last or (r["compact"] and leads(r["parent"], r["id"])):
                for x in rows[k - 1 :: -1] if k else []:
                    if x["id"] and x["id"] != r["id"] and not x["custom"] and not leads(x["id"], r["id"]):
                        if r["compact"]:
                            r["parent"], r["logical"] = None, x["id"]
                        else:
                            r["parent"] = x["id"]
                        break
    parents = [r["parent"] for r in rows if r["real_user"] and r["parent"]]
    if not (any(r["notice"] or r["type"] == replay.FORK for r in rows) or len({*parents}) < len(parents)):
        return {k for k, r in enumerate(rows) if not r["custom"]}
    target, at, out = next((r["id"] for r in reversed(rows) if r["id"] and not r["custom"]), None), len(rows) - 1, set()
    while at >= 0 and target:
        if rows[at]["id"] != target:
            at -= 1
            continue
        start = at
        while start and rows[start - 1]["id"] == target:
            start -= 1
        out |= {k for k in range(start, at + 1) if not rows[k]["custom"]}
        head, target = rows[start], None
        fork = None
        if head["real_user"]:
            for x in rows[start - 1 :: -1] if start else []:
                if x["type"] == replay.FORK:
                    fork = x
                    break
                if not (x["custom"] or x["teammate"]):
                    break
        target, at = (fork["parent"] if fork else head["parent"] or head["logical"]), start - 1
    return out


@pytest.mark.parametrize("ords", [3])
def test_random_transcripts(spark, ords):
    """Few ids, so that they repeat, lead forward, close circles and lead to themselves; some conversations lead back only."""
    rng, rows = random.Random(ords), []
    for c in range(300):
        n, straight = rng.randrange(1, 14), c % 3 == 0
        for k in range(n):
            own = f"i{k}" if straight else rng.choice([None, *(f"i{j}" for j in range(n))])
            parent = rng.choice([None, "gone", f"i{max(0, k - rng.randrange(1, 4))}"]) if straight else rng.choice([None, "gone", *(f"i{j}" for j in range(n))])
            kind = rng.choice(["user"] * 4 + ["assistant"] * 3 + ["compact", "teammate", "custom", "fork", "notice"])
            rows.append((f"c{c}", k, own, parent, rng.choice([None, None, None, f"i{rng.randrange(n)}"]), {"custom": "topic", "fork": replay.FORK}.get(kind, "message"), kind == "compact", kind == "teammate", kind == "user", kind in ("custom", "fork"), kind == "notice"))
    table = spark.createDataFrame(rows, NAMES).repartition(5)
    got = {(r.conv, r.ord) for r in replay.active(table, ords).collect()}
    columns = [x.split()[0] for x in NAMES.split(", ")]
    for c in range(300):
        own = [dict(zip(columns, r, strict=True)) for r in rows if r[0] == f"c{c}"]
        assert {k for conv, k in got if conv == f"c{c}"} == plain(own), own


def test_a_long_conversation_is_shared_out(spark):
    """Many turns with a branch left after each hundred: no task holds the conversation."""
    n = 40_000
    parent = F.when(F.col("id") % 100 == 50, F.col("id") - 3).otherwise(F.col("id") - 1)
    rows = spark.range(n, numPartitions=4).select(F.lit("c").alias("conv"), F.col("id").alias("ord"), F.concat(F.lit("m"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("m"), parent)).alias("parent"), F.lit(None).cast("string").alias("logical"), F.lit("message").alias("type"), F.lit(False).alias("compact"), F.lit(False).alias("teammate"), F.lit(False).alias("real_user"), F.lit(False).alias("custom"), (F.col("id") == n - 1).alias("notice"))
    shown = replay.active(rows, 1000)
    assert shown.count() == n - 2 * (n // 100) and shown.where("ord % 100 IN (48, 49)").count() == 0


def test_visible_text(spark):
    say = lambda content, role="user", **more: {"type": "message", "role": role, "content": content} | more
    cases = [
        (say([{"type": "input_text", "text": "visible prompt"}, {"type": "reasoning", "text": "private"}, {"type": "tool", "text": "arguments"}]), "visible prompt"),
        (say([{"type": "output_text", "text": "one"}, {"type": "text", "text": "two"}], "assistant"), "one\ntwo"),
        (say('<system-reminder data-role="user-context">private</system-reminder>\n<user_query>visible prompt</user_query><image_local_path>/private/path</image_local_path>'), "visible prompt"),
        (say('Please inspect <svg><path d="M0 0" /></svg>.'), 'Please inspect <svg><path d="M0 0" /></svg>.'),
        (say("x", providerData={"isMeta": True}), ""), (say("x", "assistant", providerData={"isMeta": True}), "x"), (say("x", providerData={"isCompactInternal": True}), ""), (say("x", "assistant", providerData={"compactType": "auto"}), ""),
        (say("<teammate-message from='w'>x</teammate-message>"), ""), (say("x", providerData={"teammateMessage": {"from": "w"}}), ""), (say("** \n Your ONLY output should be the <conversation_history_summary> y <conversation_history_summary z"), ""),
        (say("Please continue with the conversation based on the summarized context above."), ""), (say("Please continue with the conversation based on the summarized context above.", "assistant"), "Please continue with the conversation based on the summarized context above."),
        (say("<cb_summary> <previous_tool_call a> </cb_summary>", "assistant"), ""), (say("<cb_summary> a </cb_summary>", "assistant"), "<cb_summary> a </cb_summary>"), (say("  \n ", "assistant"), ""), (say(" a ", "assistant"), " a "), (say(" a "), "a"),
        (say("[{ not blocks"), "[{ not blocks"), (say([]), ""), ({"type": "tool", "role": "user", "content": "x"}, ""), (say("x", "system"), ""), ({"type": "message", "role": "user", "contentText": "told", "content": "x"}, "told"), ({}, ""),
    ]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(cases)], "k long, value string")
    got = {r.k: r.t for r in rows.select("k", replay.visible_text().alias("t")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
