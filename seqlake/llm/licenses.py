"""License scans: base phrases, and an exact set-similarity join of text blocks with templates.

DataFrame operations only. Blocks are windows of words, so that line breaks,
comment marks and sentences make no difference: for the templates of at most
16, 64 and 256 words, windows of twice as many words, each beginning that many
after the last, so that a notice of up to that length lies whole in one. A
template matches a block that has at least THRESHOLD of its distinct words and,
so that their order counts, at least IN_ORDER of its distinct pairs of
neighbouring words. The join on the words is exact and filters by

- length: a block needs as many template words as the threshold asks for;
- prefix: words are ordered by how many documents of the whole corpus have
  them, rarest first; of two sets with enough words in common, a word is in the
  first few of both;
- position: what may still follow after that word must be enough.

The templates are few and fixed; that side is broadcast. Words that no template
has cannot count, so a block's set is of template words only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

THRESHOLD, IN_ORDER = 0.9, 0.7
#: Words of the longest templates of each kind of window.
CAPS = [16, 64, 256]
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Words of license notices, short ones and whole texts, and their labels. Of up to nine distinct words none may be missing.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("free software foundation either version 3 of the license", "gpl-3"),
    ("free software foundation either version 2 of the license", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see",
        "gpl",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]


def spaced_words(text: Column) -> Column:
    """The words, A-Z lower-cased, with a space before, between and after them; a space for none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), f"(?:{SEPARATOR})", " ")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def pairs_of(words: list[str]) -> list[str]:
    """The distinct pairs of neighbours, each with a space before, between and after."""
    return sorted({f" {a} {b} " for a, b in zip(words, words[1:])})


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, in_order: float = IN_ORDER) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks: the matched blocks (first word, label, share). score: the
    highest share, 1 where a base phrase stands, 0 where nothing is found. A
    null text counts as empty: no words, no labels. Repeated rows and null ids
    get a row each. An empty table gives an empty result. Only doc_id and text
    are read. Templates have at most CAPS[-1] words.
    """
    spark = docs.sparkSession
    listed = [(k, words.split(), label) for k, (words, label) in enumerate(templates)]
    if any(len(words) > CAPS[-1] for _, words, _ in listed):
        raise ValueError(f"a template has at most {CAPS[-1]} words")
    cap = {k: next(c for c in CAPS if len(words) <= c) for k, words, _ in listed}
    sets = [(k, sorted(set(words)), label) for k, words, label in listed]
    need = {k: max(1, math.ceil(threshold * len(words) - 1e-9)) for k, words, _ in sets}
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])

    def may_hold(words: Column, cap_: int | None = None) -> Column:
        """The length filter: enough words for some template."""
        out = F.lit(False)
        for k, own, _ in sets:
            if cap_ in (None, cap[k]):
                out = out | (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) >= need[k])
        return out

    first = docs.select("doc_id", "text", spaced_words(F.col("text")).alias("s"))
    first = first.withColumn("tokens", F.array_intersect(known, F.split("s", " ")))
    n_words = F.when(F.col("s") == " ", F.lit(0)).otherwise(_spaces(F.col("s")) - 1)
    starts, counts, ends, labels = [], [], [], []
    for phrase, label in PHRASES:
        here = F.contains(F.col("s"), F.lit(f" {phrase} "))
        after = _spaces(F.substring_index("s", f" {phrase} ", -1))
        counts.append(F.when(here, F.regexp_count("s", F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        starts.append(F.when(here, _spaces(F.substring_index("s", f" {phrase} ", 1))))
        ends.append(F.when(here, n_words - after - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    def windows(words: Column, c: int) -> Column:
        """(cap, first word, words, distinct template words) of the windows that have enough of those for some template of the kind."""
        least = min(need[k] for k in need if cap[k] == c)
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1), F.lit(c)), lambda i: F.struct(
            F.lit(c).alias("cap"), i.alias("at"), F.slice(words, i + 1, F.lit(2 * c)).alias("all"),
        ))
        made = F.transform(made, lambda x: F.struct(x["cap"].alias("cap"), x["at"].alias("at"), F.array_join(x["all"], " ").alias("raw"), F.array_intersect(known, x["all"]).alias("words")))
        return F.when(may_hold(F.col("tokens"), c), F.filter(made, lambda x: F.size(x["words"]) >= least))

    none = F.array().cast("array<struct<cap:int,at:int,raw:string,words:array<string>>>")
    split = F.array(F.split(F.btrim("s"), " "))
    # The outer transform binds the words, so that a text is split once.
    blocks = F.flatten(F.transform(split, lambda w: F.concat(*[F.coalesce(windows(w, c), none) for c in sorted(set(cap.values()))])))
    rows = first.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", n_words.cast("long").alias("n_words"), sum(counts).alias("n_base"),
        F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), "tokens",
        F.when(may_hold(F.col("tokens")) & F.col("text").isNotNull(), blocks).alias("blocks"),
    )
    rows = settle(rows)
    # The order of the template words by the documents that have them; no more rows than the templates have words.
    seen = {r["w"]: r["n"] for r in rows.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    prefix = []
    for k, words, label in sets:
        ranked = sorted(words, key=order.get)
        prefix += [(w, k, cap[k], label, len(words), need[k], i) for i, w in enumerate(ranked[: len(words) - need[k] + 1])]
    wanted = spark.createDataFrame(prefix, "w string, k int, cap int, label string, size int, need int, j int")
    rank = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    block = rows.where("blocks is not null").select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    block = block.withColumn("words", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    token = block.select("row", "cap", "at", "raw", "words", F.posexplode("words").alias("i", "w"))
    near = token.join(F.broadcast(wanted), ["w", "cap"]).where(
        (F.size("words") >= F.col("need")) & (F.col("i") <= F.size("words") - F.col("need"))
        & (1 + F.least(F.size("words") - 1 - F.col("i"), F.col("size") - 1 - F.col("j")) >= F.col("need"))
    )
    whole = spark.createDataFrame([(k, sorted(set(words)), pairs_of(words)) for k, words, _ in listed], "k int, template array<string>, pairs array<string>")
    both = near.select("row", "cap", "at", "raw", "words", "k", "label", "size", "need").dropDuplicates(["row", "cap", "at", "k"]).join(F.broadcast(whole), "k")
    both = both.withColumn("common", F.size(F.array_intersect("words", "template"))).where("common >= need")
    # Between neighbouring words there is one space, so two pairs may share it: each is looked for on its own.
    around = F.concat(F.lit(" "), F.col("raw"), F.lit(" "))
    both = both.where(F.size(F.filter("pairs", lambda x: F.contains(around, x))) >= F.ceil(F.size("pairs") * in_order - 1e-9))
    found = both.groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("share"),
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), "label", (F.col("common") / F.col("size")).alias("share")))).alias("matches"),
    )
    found = settle(found)
    out = rows.join(found, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), F.col("matches").alias("blocks"))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs).drop("blocks")
