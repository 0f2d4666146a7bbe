"""License scans as an exact set-similarity join, with DataFrame functions only.

A text block, that is a run of words a quarter longer than a template, whatever lines it spans, matches the
template when it holds at least THRESHOLD of the template's distinct words. A template's words are ordered by
how many documents hold them, rarest first. A block that matches must hold one of the first |T| - c + 1 of
them (prefix filter), at least c words (length filter), and from the rarest word that it holds on, the template
must have c words left (positional filter), where c is the overlap that the threshold asks for.

Templates are few and fixed, so their inverted lists (word: templates and places in their order) travel as a
literal. Only texts with a prefix word of some template are cut into words, and only templates of which a
text holds a prefix word are looked at in it, inside its row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Labels and operative sentences of common license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}
#: Phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: str) -> list[str]:
    return [w for w in re.split(_APART, text.lower()) if w]


def template_words(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """Distinct words of each template, in order of their first place."""
    return {k: list(dict.fromkeys(_words(v))) for k, v in templates.items()}


def widths(templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """How many words the text blocks have that each template is held against."""
    return {k: n + n // 4 for k, v in templates.items() for n in [len(_words(v))]}


def needed(words: int, threshold: float) -> int:
    """The overlap that the threshold asks of a template of so many words."""
    return max(1, math.ceil(threshold * words - 1e-9))


def word_frequencies(docs: DataFrame, words: list[str]) -> DataFrame:
    """(word, n): in how many documents each of some words stands."""
    held = F.array_distinct(F.filter(F.split(_lower(F.col("text")), _APART), lambda w: w.isin(*words)))
    return docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ordered_templates(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """Each template's words, rarest in docs first, equally rare ones by name."""
    words = template_words(templates)
    counts = {r.word: r.n for r in word_frequencies(docs, sorted({w for ws in words.values() for w in ws})).collect()}
    return {k: sorted(ws, key=lambda w: (counts.get(w, 0), w)) for k, ws in words.items()}


def containments(line: Column, ordered: dict[str, list[str]], width: dict[str, int], threshold: float = THRESHOLD) -> Column:
    """array<struct<label, word, share>> of the text blocks of a line of words that match a template.

    line: words with single blanks between them, one before and one behind. A block is named by its first
    word (from 0), which is always one of the template's.
    """
    need = {k: needed(len(ws), threshold) for k, ws in ordered.items()}
    prefixes = sorted({w for k, ws in ordered.items() for w in ws[: len(ws) - need[k] + 1]})
    none = F.array().cast("array<struct<label:string,word:int,share:double>>")
    if not prefixes:
        return none
    some = rf"(?i) (?:{'|'.join(prefixes)}) "
    lists: dict[str, list[Column]] = {}
    for k, (label, ws) in enumerate(ordered.items()):
        for r, w in enumerate(ws):
            lists.setdefault(w, []).append(F.struct(F.lit(k).alias("of"), F.lit(r).alias("rank")))
    inverted = F.create_map(*[x for w, entries in lists.items() for x in (F.lit(w), F.array(*entries))])
    facts = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(width[k]).alias("width"), F.lit(need[k]).alias("need"), F.lit(len(ws)).alias("size"), F.lit(k2).alias("of")) for k2, (k, ws) in enumerate(ordered.items())])

    def entries(words: Column) -> Column:
        """(word, of, rank) of all template words of a text, in order."""
        placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("word"))), lambda x: x["w"].isin(*lists))
        return F.flatten(F.transform(placed, lambda x: F.transform(inverted[x["w"]], lambda e: F.struct(x["word"].alias("word"), e["of"].alias("of"), e["rank"].alias("rank")))))

    def blocks_of(held: Column, fact: Column) -> Column:
        own = F.filter(held, lambda e: e["of"] == fact["of"])

        def judged(own: Column) -> Column:
            def block(e: Column, i: Column) -> Column:
                near = F.filter(F.slice(own, i + 1, fact["width"]), lambda x: x["word"] < e["word"] + fact["width"])
                ranks = F.transform(near, lambda x: x["rank"])
                # length: as many words as are needed; position: from the block's rarest word on the template has as many
                open_ = (F.size(near) >= fact["need"]) & (fact["size"] - F.array_min(ranks) >= fact["need"])
                both = F.when(open_, F.size(F.array_distinct(ranks)))  # the overlap itself only of what both leave
                return F.struct(fact["label"].alias("label"), e["word"].alias("word"), F.when(both >= fact["need"], both / fact["size"]).alias("share"))

            return F.filter(F.transform(own, block), lambda x: x["share"].isNotNull())

        return F.get(F.transform(F.array(own), judged), F.lit(0))

    def found(held: Column) -> Column:
        met = F.filter(facts, lambda f: F.exists(held, lambda e: (e["of"] == f["of"]) & (e["rank"] <= f["size"] - f["need"])))
        return F.flatten(F.transform(met, lambda f: blocks_of(held, f)))

    words = F.split(F.trim(_lower(line)), " ")
    return F.when(line.rlike(some), F.get(F.transform(F.array(entries(words)), found), F.lit(0))).otherwise(none)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and n_words, n_base, first_word, last_word (long), base_labels, blocks.

    Words are runs of ASCII letters (A-Z folded), digits and characters above ASCII. base_labels are the
    sorted labels of PHRASES in the text, n_base the places where they stand, first_word and last_word
    their smallest and largest start (null without any). blocks: matched runs of words, as `containments`
    gives them. Null and empty texts hold no words. Each row is judged by itself, repeated rows alike; the
    order of template words comes from all rows. Clashing column names are refused.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")
    if clash := {*new, "_line", "_parts"} & {*docs.columns}:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    ordered = ordered_templates(docs, templates)
    # words between single blanks, one blank before and behind; case stays, as patterns ignore it
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _APART, " ")), F.lit(" "))
    rows = docs.withColumn("_line", line)
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    n_words = F.when(F.col("_line") == "  ", F.lit(0)).otherwise(blanks(F.col("_line")) - 1)
    parts = []
    for phrase, label in PHRASES.items():
        first, rest = phrase.split(" ", 1)
        found = F.split("_line", rf"(?i) {first}(?= {rest} )")
        parts.append(F.when(F.col("_line").rlike(rf"(?i) {phrase} "), F.struct(F.lit(label).alias("label"), found.alias("cut"))))
    rows = rows.withColumn("n_words", n_words.cast("long")).withColumn("_parts", F.filter(F.array(*parts), lambda x: x.isNotNull()))
    places = F.aggregate("_parts", F.lit(0), lambda n, x: n + F.size(x["cut"]) - 1)
    start = F.array_min(F.transform("_parts", lambda x: blanks(F.element_at(x["cut"], 1))))
    last = F.array_max(F.transform("_parts", lambda x: F.col("n_words") - blanks(F.element_at(x["cut"], -1))))
    return rows.select(
        *docs.columns, "n_words", places.cast("long").alias("n_base"), start.cast("long").alias("first_word"), last.cast("long").alias("last_word"),
        F.array_sort(F.transform("_parts", lambda x: x["label"])).alias("base_labels"), containments(F.col("_line"), ordered, widths(templates), threshold).alias("blocks"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
