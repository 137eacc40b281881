"""License scan: exact set-similarity join of text blocks with license templates.

A block is a line of text, long lines cut into overlapping windows; after the
lines come windows over the words of the whole text, across line breaks, so that
wrapped passages are whole in one of them.  A block
matches a template when it holds at least ``containment`` of the template's
distinct words (all of them where they are few).  Words are ordered by how many documents hold them, rarest
first, and that order gives three exact filters:

* prefix: an overlap of ``need`` words must touch the first ``|T| - need + 1``
  words of the template and the first ``|B| - need + 1`` of the block;
* length: a block with fewer than ``need`` template words cannot match;
* position: where the first common word stands bounds the overlap that is left.

Templates are a small fixed table, so the join needs no shuffle: each document
is joined to them in place, by built-in functions only.  Base phrases are found
by one pattern over the whole text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase -> label of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Template text -> label.  The opening or naming sentences of public licenses.
TEMPLATES = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "Licensed under the Apache License, Version 2.0": "apache",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: GPL-3.0": "gpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-ND 4.0": "cc-by-nd",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "Licensed under CC BY-NC-ND 4.0": "cc-by-nc-nd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl",
}
#: Share of a template's distinct words that a block must hold.  Templates of fewer than
#: ``SHORT`` words must be held whole: most of so few words meet by chance.
CONTAINMENT, SHORT = 0.8, 10
#: Words of a block at most; longer lines and whole texts are cut every half of it.
BLOCK_WORDS = 64

#: A word after lower-casing A-Z, and the same before it.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: str) -> list[str]:
    return re.findall(LOWER_WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def needed(n_words: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of ``n_words`` distinct words that a block must hold."""
    return n_words if n_words < SHORT else math.ceil(containment * n_words)


def _phrase(words: list[str]) -> str:
    return f"{GAP}+".join(words)


def _places(phrases: list[str]) -> str:
    """Pattern of whole-word places of any of the phrases, in either case."""
    return f"(?i)(?<!{WORD})(?:{'|'.join(_phrase(words_of(p)) for p in phrases)})(?!{WORD})"


def word_ranks(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, the
    rarest first, ties by the word.  One row a template word reaches the driver."""
    found = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), f"{GAP}+"), F.lit(vocabulary))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, base: dict[str, str] | None = None
) -> DataFrame:
    """Per document ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score`` and ``matches``: the matching blocks as
    ``array<struct<block, template, containment>>`` (block numbers from 0); of a
    block's matches those of the highest containment give labels.

    Null and empty texts have no words, no labels ('') and score 0.  Repeated
    rows give repeated results.  An empty table gives no rows.  Other columns
    of ``docs`` are ignored.  ``score`` is 1 with a base phrase, else the best
    containment of a matching template, else 0.
    """
    templates, base = templates or TEMPLATES, base or BASE
    sets = [(sorted(set(words_of(t))), label) for t, label in templates.items()]
    vocabulary = sorted({w for ws, _ in sets for w in ws})
    rank = word_ranks(docs, vocabulary, text_col)
    by_rank = sorted(vocabulary, key=rank.get)

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    text = F.col("text")
    any_base = _places(list(base))
    found = source.withColumn("n_base", F.regexp_count("text", F.lit(any_base)).cast("long"))
    count = lambda t: F.regexp_count(t, F.lit(f"{WORD}+")).cast("long")
    before_first = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(any_base)) - 1)
    before_last = F.regexp_extract(text, f"(?s)^(.*){any_base}", 1)

    # a document can hold a match only if it holds a word of some template's prefix
    prefixes = sorted({w for ws, _ in sets for w in sorted(ws, key=rank.get)[: len(ws) - needed(len(ws), containment) + 1]})
    may_match = F.array_size(F.array_intersect(F.split(F.lower(text), f"{GAP}+"), F.lit(prefixes))) > 0
    matches = F.when(may_match, _matches(text, sets, by_rank, rank, containment)).otherwise(F.array().cast(MATCH))

    flags = [(label, F.col("n_base") > 0, F.regexp_count(text, F.lit(_places([p for p, x in base.items() if x == label]))) > 0) for label in sorted(set(base.values()))]
    base_labels = F.array_compact(F.array(*[F.when(some & own, F.lit(label)) for label, some, own in flags]))
    scanned = found.select(
        "doc_id",
        count(text).alias("n_words"),
        "n_base",
        F.when(F.col("n_base") > 0, count(before_first)).alias("first_word"),
        F.when(F.col("n_base") > 0, count(before_last)).alias("last_word"),
        F.when(F.col("n_base") > 0, base_labels).otherwise(F.array().cast("array<string>")).alias("base_list"),
        matches.alias("matches"),
    )
    label_of = F.create_map(*[F.lit(x) for k, (_, label) in enumerate(sets) for x in (k, label)])
    # close templates match together; a block's label is that of the template it holds most of
    best = lambda m: F.array_max(F.transform(F.filter("matches", lambda x: x["block"] == m["block"]), lambda x: x["containment"]))
    own = F.transform(F.filter("matches", lambda m: m["containment"] >= best(m)), lambda m: F.element_at(label_of, m["template"]))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"),
        "matches",
    )


MATCH = "array<struct<block:int,template:int,containment:double>>"


def _matches(text: Column, sets: list[tuple[list[str], str]], by_rank: list[str], rank: dict[str, int], containment: float) -> Column:
    """The matching blocks of one text, as an array built by array functions."""
    vocabulary = F.lit(by_rank)

    def blocks(words: Column) -> Column:
        half = BLOCK_WORDS // 2
        cuts = F.sequence(F.lit(0), F.greatest(F.size(words) - BLOCK_WORDS + half - 1, F.lit(0)), F.lit(half))
        # ranks of the template words that the block holds, rarest first
        return F.transform(cuts, lambda c: F.array_sort(F.transform(F.array_intersect(F.slice(words, c + 1, BLOCK_WORDS), vocabulary), lambda w: F.array_position(vocabulary, w).cast("int") - 1)))

    # only ASCII words are in the vocabulary, and a translated text has no other lower-case ones
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wrapped = F.when(F.contains(lower, F.lit("\n")), F.array(lower)).otherwise(F.array().cast("array<string>"))
    worded = F.transform(F.concat(F.split(lower, "\n"), wrapped), lambda line: F.filter(F.split(line, f"{GAP}+"), lambda w: w != ""))
    every = F.flatten(F.transform(worded, blocks))  # words are bound, not split again for every cut
    numbered = F.filter(F.transform(every, lambda b, k: F.struct(k.alias("k"), b.alias("b"))), lambda x: F.size(x["b"]) > 0)

    def against(x: Column) -> Column:
        def one(k: int, words: list[str]) -> Column:
            ranks, need = sorted(rank[w] for w in words), needed(len(words), containment)
            mine, theirs = F.lit(ranks), x["b"]
            prefix = F.lit(ranks[: len(ranks) - need + 1])
            head = F.slice(theirs, 1, F.greatest(F.size(theirs) - need + 1, F.lit(0)))
            first = F.array_min(F.array_intersect(head, prefix))  # the rarest common word
            left = F.least(F.lit(len(ranks)) - F.array_position(mine, first), F.size(theirs) - F.array_position(theirs, first))
            common = F.size(F.array_intersect(theirs, mine))
            return F.when(
                (F.size(theirs) >= need) & F.arrays_overlap(head, prefix) & (left + 1 >= need) & (common >= need),
                F.struct(x["k"].cast("int").alias("block"), F.lit(k).alias("template"), (common / F.lit(float(len(ranks)))).alias("containment")),
            )

        return F.array_compact(F.array(*[one(k, words) for k, (words, _) in enumerate(sets)]))

    return F.flatten(F.transform(numbered, against)).cast(MATCH)
