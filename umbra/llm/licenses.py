"""License scan: an exact set-similarity join of text blocks with license templates, DataFrame functions only.

A block is a run of words, whatever lines they stand on: for templates of up to S words (S a power of two) the runs of
2 S words that begin at every S-th word, so that each passage of the template's length lies within one. A block's set is
its distinct lower-cased words. It holds a template when |block & template| >= ceil(threshold * |template|) = o. The
join is exact and prunes as set joins do: template words are ordered by the number of documents that hold them (counted
over the whole corpus, ties by the word), rarest first; a block that reaches o must share one of the template's first
|template| - o + 1 words (prefix filter), must have at least o template words itself (length filter), and o must still
be reachable from the place of the shared word in both orders (positional filter). What is left is confirmed on the
whole sets. Only texts that hold a prefix word, and of them blocks that do, become rows; the template index is a fixed
list, broadcast. Texts are tokenized once for the counts and once for the rest, and never shuffled.

Besides, the phrases of PHRASES are looked for word by word in the whole text (the base labels).

Null and empty texts have no words: counts 0, places null, labels "". Repeated rows are treated alike, ties between
words of equal frequency go by the word. A very long text is one row of words in memory. An empty table gives an empty
result; extra columns are ignored. The score is the largest containment found, 1 where a phrase stands, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.session import cut

#: Phrase and label of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The texts and notices of well-known licenses, and their labels.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc-by-nc", "CC-BY-NC-4.0"),
    ("cc-by-sa", "CC-BY-SA-4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. CC0"),
]
#: At 0.9 none of five words may be missing, so CC-BY-SA isn't taken for CC-BY-NC.
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words in text of either case, and of lower-cased text.
SPLIT = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SCHEMA = "step int, label string, template int, size int, need int, place int, word string, words array<string>"


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def every_word(text: str) -> list[str]:
    """Lower-cased words of a template."""
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    """The distinct ones, in order."""
    return list(dict.fromkeys(every_word(text)))


def step_of(text: str) -> int:
    """Words from one block to the next; a block has twice as many."""
    return 1 << (len(every_word(text)) - 1).bit_length()


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows of texts that hold each word of the (fixed) vocabulary; one row for each word reaches the driver."""
    held = F.array_intersect(words_of(lower(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    counts = texts.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in counts.collect()}


def template_index(templates: list[tuple[str, str]], frequencies: dict[str, int], threshold: float) -> tuple[list[tuple], list[str]]:
    """SCHEMA rows, one for each prefix word of each template, and all templates' words, rarest first."""
    sets = [template_words(text) for _, text in templates]
    order = sorted({w for s in sets for w in s}, key=lambda w: (frequencies.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t, ((label, text), s) in enumerate(zip(templates, sets, strict=True)):
        s = sorted(s, key=rank.__getitem__)
        need = math.ceil(threshold * len(s) - 1e-9)
        index += [(step_of(text), label, t, len(s), need, p, w, s) for p, w in enumerate(s[: len(s) - need + 1])]
    return index, order


def blocks_of(words: Column, step: int, prefix: list[str]) -> Column:
    """(step, all): the blocks of words that hold one of prefix."""
    telling = F.array(*map(F.lit, prefix))
    each = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(step)), lambda i: F.slice(words, i, F.lit(2 * step)))
    return F.transform(F.filter(each, lambda b: F.arrays_overlap(b, telling)), lambda b: F.struct(F.lit(step).alias("step"), b.alias("all")))


def containment_join(texts: DataFrame, index: list[tuple], order: list[str]) -> DataFrame:
    """texts (key, words) to (key, label, score): every label of which a block of the text holds a template."""
    table = F.broadcast(texts.sparkSession.createDataFrame(index, SCHEMA))
    blocks = [blocks_of(F.col("words"), step, sorted({r[6] for r in index if r[0] == step})) for step in sorted({r[0] for r in index})]
    ordered = F.array(*map(F.lit, order))
    each = texts.where(F.size("words") > 0).select("key", F.explode(F.concat(*blocks)).alias("b"))
    # array_intersect keeps the first array's order: the block's template words, rarest first
    own = each.select("key", F.col("b.step").alias("step"), F.array_intersect(ordered, "b.all").alias("own")).select("key", "step", "own", F.posexplode("own").alias("at", "word"))
    joined = own.join(table, ["step", "word"]).where((F.size("own") >= F.col("need")) & (1 + F.least(F.size("own") - F.col("at") - 1, F.col("size") - F.col("place") - 1) >= F.col("need")))
    shared = joined.select("key", "label", "need", "size", F.size(F.array_intersect("own", "words")).alias("n"))
    return shared.where("n >= need").select("key", "label", (F.col("n") / F.col("size")).alias("score"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split()

    def stands(x: Column, i: Column) -> Column:
        ok = x == parts[0]
        for j, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + j) == p, F.lit(False))
        return ok

    return F.filter(F.transform(words, lambda x, i: F.when(stands(x, i), i.cast("bigint"))), lambda i: i.isNotNull())


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    index, order = template_index(templates, document_frequencies(texts, vocabulary), threshold)
    telling = sorted({r[6] for r in index} | {p.split()[0] for p in phrases})
    # A key in each row: doc_ids may repeat, and equal texts get equal labels.
    all_words = texts.select("doc_id", F.xxhash64("text").alias("h"), words_of(lower(F.col("text"))).alias("words"))
    may = F.arrays_overlap("words", F.array(*map(F.lit, telling)))
    rows = cut(all_words.select("doc_id", "h", F.size("words").cast("bigint").alias("n_words"), F.when(may, F.col("words")).alias("words")))

    named = rows.where("words IS NOT NULL").select(F.struct("doc_id", "h").alias("key"), "words").dropDuplicates(["key"])
    held = containment_join(named, index, order).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("held"))
    held = held.select(F.col("key.doc_id").alias("doc_id"), F.col("key.h").alias("h"), "more", "held")

    none = F.array().cast("array<bigint>")
    based = rows.select("doc_id", "h", "n_words", *[F.coalesce(phrase_places(F.col("words"), p), none).alias(f"p{i}") for i, p in enumerate(phrases)])
    places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))))
    based = based.select(
        "doc_id", "h", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), labels.alias("base")
    )
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return based.join(held, (based["doc_id"].eqNullSafe(held["doc_id"])) & (based["h"] == held["h"]), "left").select(
        based["doc_id"],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("held", F.lit(0.0))).alias("score"),
    )
