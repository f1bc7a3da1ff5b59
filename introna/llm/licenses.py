"""License scans by diagonal voting, in DataFrame functions only.

1. Every run of three words of a text, hashed, is joined to the places where it stands in a template
   (a known license wording); the words themselves are compared where the hashes agree.
2. A hit votes for its diagonal, the offset between text and template. Votes of one diagonal are
   combined before the shuffle, so a wording that half the corpus holds costs one row per place and task.
3. Diagonals with few votes go; what is left is merged with its neighbours, since a word put in or left
   out moves the rest of a wording to the next diagonal.
4. A merged span is verified by the template's words that it covers: all of a short wording, 80 % of a
   longer one, and not strewn over much more text than the template has. Where verified spans overlap,
   those that cover most of their template's words stay, so a license is not taken for its sibling.

Phrases are wordings that count only where they stand word for word; each of their places is counted.

Defined results: a null, empty or wordless text has no words, no places, empty labels and score 0;
a null doc_id is a value like any other; repeated rows give equal rows; texts of any length are scanned
whole; only doc_id and text are read, so further columns and their names do not matter; an empty table
gives an empty result; a template of fewer than three words is an error.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from introna.llm.common import stored

K = 3  # words of a gram
SHORT = 10  # wordings of fewer words must be there in full
COVER_PERCENT = 80  # of the words of a longer wording
FEW_PERCENT = 10  # of a template's grams that a diagonal needs to count
SMALL_TEMPLATES = 100_000  # words of all templates up to which they are broadcast

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Wordings of public licenses and of the notices that refer to them.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_CREATIVE = "licensed under a Creative Commons Attribution{} 4.0 International License"
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied."),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-2", _GPL.format("General Public License", 2)),
    ("gpl-3", _GPL.format("General Public License", 3)),
    ("lgpl-3", _GPL.format("Lesser General Public License", 3)),
    ("agpl-3", _GPL.format("Affero General Public License", 3)),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", _CREATIVE.format("")),
    ("cc-by-sa", _CREATIVE.format("-ShareAlike")),
    ("cc-by-nd", _CREATIVE.format("-NoDerivatives")),
    ("cc-by-nc", _CREATIVE.format("-NonCommercial")),
    ("cc-by-nc-sa", _CREATIVE.format("-NonCommercial-ShareAlike")),
    ("cc-by-nc-nd", _CREATIVE.format("-NonCommercial-NoDerivatives")),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
)


def plain_words(text: str) -> list[str]:
    """Words of a wording, A-Z in lower case."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per gram of a template: template, label, exact, length, slack, at, a, b, c."""
    listed = [(n, label, n >= len(templates), plain_words(text)) for n, (label, text) in enumerate([*templates, *phrases])]
    if not listed or any(len(words) < K for *_, words in listed):
        raise ValueError(f"templates are needed, each of {K} words or more")
    rows = [
        F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(" ".join(words)).alias("wording"))
        for n, label, exact, words in listed
    ]
    told = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", F.split("wording", " ")).withColumn("length", F.size("words"))
    told = told.withColumn("slack", F.ceil(F.col("length") / 10).cast("int"))
    grams = _grams(told, "template", "label", "exact", "length", "slack")
    return F.broadcast(grams) if sum(len(words) for *_, words in listed) <= SMALL_TEMPLATES else grams


def _grams(rows: DataFrame, *keys: str) -> DataFrame:
    """Explode ``words`` of every row to its grams: the keys, at, a, b, c (words at, at + 1 and at + 2)."""
    size = F.size("words")
    laid = rows.select(
        *keys, F.col("words").alias("a"), F.slice("words", F.lit(2), size).alias("b"), F.slice("words", F.lit(3), size).alias("c"),
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))).alias("at"),
    )
    return laid.select(*keys, F.inline(F.arrays_zip("at", "a", "b", "c"))).where("c is not null")


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits of both, by which a row is known."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(13), "text", "doc_id").alias("k2"))


def diagonals(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """Votes of every row and template by offset: k1, k2, template, ..., diagonal, at (matched places of the template)."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    grams = _grams(keyed.select("k1", "k2", words.alias("words")), "k1", "k2").withColumn("hash", F.xxhash64(*(F.lower(x) for x in "abc")))
    known = templates.withColumn("hash", F.xxhash64("a", "b", "c")).select(
        "template", "label", "exact", "length", "slack", F.col("at").alias("place"), "hash", *(F.col(x).alias(f"t{x}") for x in "abc")
    )
    # lower() also turns a few letters outside ASCII into ASCII ones: the words decide
    same = [F.translate(F.col(x), UPPER, LOWER) == F.col(f"t{x}") for x in "abc"]
    hits = grams.join(known, "hash").where(same[0] & same[1] & same[2])
    keys = ["k1", "k2", "template", "label", "exact", "length", "slack"]
    return hits.groupBy(*keys, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("at"))


def spans(votes: DataFrame) -> DataFrame:
    """Merged spans: k1, k2, template, label, length, start, stop (words of the text), matched, verified."""
    enough = votes.where(~F.col("exact") & (100 * F.size("at") >= FEW_PERCENT * (F.col("length") - K + 1)))
    keys = ["k1", "k2", "template"]
    order = Window.partitionBy(*keys).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    island = F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + K - 1))))
    placed = enough.withColumn("island", island).withColumn("words", covered).withColumn("alone", F.size("words"))
    merged = placed.select(*keys, "label", "length", "slack", "island", "alone", "diagonal", F.explode("words").alias("word")).groupBy(
        *keys, "label", "length", "slack", "island"
    ).agg(
        F.size(F.collect_set("word")).alias("together"), F.max("alone").alias("alone"),
        F.min(F.col("diagonal") + F.col("word")).alias("start"), (F.max(F.col("diagonal") + F.col("word")) + 1).alias("stop"),
    )
    near = 2 * (F.col("stop") - F.col("start")) <= 3 * F.col("length") + 2 * F.col("slack")
    merged = merged.withColumn("matched", F.when(near, F.col("together")).otherwise(F.col("alone")))
    whole = F.when(F.col("length") < SHORT, F.col("matched") == F.col("length")).otherwise(100 * F.col("matched") >= COVER_PERCENT * F.col("length"))
    return merged.select(*keys, "label", "length", "start", "stop", "matched", whole.alias("verified"))


def best(found: DataFrame) -> DataFrame:
    """Of verified spans that overlap, those that match most words of their template."""
    sure = found.where("verified")
    order = Window.partitionBy("k1", "k2").orderBy("start", "stop", "template")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    sure = sure.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    worth = F.struct("matched", -F.col("length"))
    sure = sure.withColumn("worth", worth).withColumn("most", F.max("worth").over(Window.partitionBy("k1", "k2", "group")))
    return sure.where("worth = most").drop("fresh", "group", "worth", "most")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest matched share of a template, 1 where a phrase stands.
    """
    keyed = _key(docs)
    votes = stored(diagonals(keyed, template_grams(docs.sparkSession, templates, phrases)), "license-votes")
    keys = ["k1", "k2"]
    found = stored(spans(votes), "license-spans")
    full = F.col("exact") & (F.size("at") == F.col("length") - K + 1)
    parts = votes.where(full).select(*keys, F.col("label").alias("base"), F.col("diagonal").alias("word"))
    parts = parts.unionByName(best(found).select(*keys, F.col("label").alias("more")), allowMissingColumns=True)
    parts = parts.unionByName(found.select(*keys, (F.col("matched") / F.col("length")).alias("share")), allowMissingColumns=True)
    told = parts.groupBy(*keys).agg(
        F.count("base").alias("n_base"), F.min("word").alias("first_word"), F.max("word").alias("last_word"),
        F.collect_set("base").alias("base"), F.collect_set("more").alias("more"), F.max("share").alias("share"),
    )
    rows = keyed.select("doc_id", *keys, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words")).join(told, keys, "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
