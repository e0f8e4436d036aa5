"""License scans by diagonal voting, in DataFrame functions alone.

The rolling K-word hashes of every text are joined with the positions of the same hashes in the license
templates (a broadcast table of a fixed size). A match votes for its offset diagonal, text position minus
template position; votes are added up for each text, template and diagonal, diagonals at most SLACK apart
are merged (inserted or dropped words), and a span is verified: it must hold at least NEED of the template's
distinct K-grams, and be at most STRETCH times as long as the template.

One pass over the texts: rows without a match are dropped right after the join, but for the first of each
text, which carries the text's own counts.

Defined results: a null text is empty, with no words and no labels. Repeated rows are judged each by itself;
null ids stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents

K = 4
SLACK = 6
NEED = 0.6
STRETCH = 2.0
#: JVM pattern of what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base columns.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license notices, with the label that each gives.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, place, gram): a row for each K-gram of each template."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        words = template_words(text)
        for i in range(len(words) - K + 1):
            gram = F.xxhash64(*[F.lit(w) for w in words[i : i + K]])
            rows.append(F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(i).alias("place"), gram.alias("gram")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def sizes() -> Column:
    """Distinct K-grams and words of a template, by its number."""
    grams = []
    for _, text in TEMPLATES:
        words = template_words(text)
        grams.append((len({tuple(words[i : i + K]) for i in range(len(words) - K + 1)}), len(words)))
    return F.array(*[F.struct(F.lit(g).alias("grams"), F.lit(w).alias("words")) for g, w in grams])


def _phrase_places() -> Column:
    """Starts of base phrases, each times 4 plus the phrase's number; only texts with their last word are looked at."""
    words = F.col("words")

    def at(w: Column, i: Column) -> Column:
        found = None
        for number, (phrase, _) in enumerate(PHRASES):
            parts = phrase.split(" ")
            n = len(parts)
            fits = w == parts[-1]
            for back in range(1, n):
                fits = fits & (F.get(words, i - back) == parts[-1 - back])
            value = (i - (n - 1)) * 4 + number
            found = F.when(fits, value) if found is None else found.when(fits, value)
        return found

    places = F.filter(F.transform(words, at), lambda x: x.isNotNull())
    return F.when(F.contains("low", F.lit("license")), places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the verified spans, of every row."""
    spark = docs.sparkSession
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase).alias("low"))
    words = words.select("doc_id", "low", F.array_remove(F.split("low", BETWEEN), "").alias("words"))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, K)]))
    rows = words.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), _phrase_places().alias("places"), grams.alias("grams"))
    flag = lambda c: F.exists("places", lambda x: x % 4 == c).cast("int")
    mask = sum((flag(c) * (1 << c) for c in range(1, len(PHRASES))), flag(0))
    rows = rows.select("rid", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.floor(F.array_min("places") / 4).alias("first_word"), F.floor(F.array_max("places") / 4).alias("last_word"), mask.alias("mask"), "grams")
    rows = rows.select("rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "mask", F.posexplode_outer("grams").alias("pos", "gram"))
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "mask"]
    met = rows.join(F.broadcast(templates(spark)), "gram", "left").where("template is not null or pos is null or pos = 0")
    votes = met.groupBy("rid", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        *[F.max(c).alias(c) for c in own], F.collect_set("gram").alias("seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("label").alias("label")
    )
    w = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) > SLACK, 1).otherwise(0)
    merged = votes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(w)).groupBy("rid", "template", "run").agg(
        *[F.max(c).alias(c) for c in own], F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("label").alias("label")
    )
    size = F.get(sizes(), F.coalesce("template", F.lit(0)))
    share = F.when(F.col("template").isNotNull(), F.col("hits") / size["grams"])
    fits = (share >= NEED) & (F.col("hi") - F.col("lo") + K <= size["words"] * STRETCH)
    span = F.when(fits, F.struct("label", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + K).alias("length"), share.alias("share")))
    of_doc = merged.withColumn("span", span).groupBy("rid").agg(*[F.max(c).alias(c) for c in own], F.array_sort(F.collect_list("span")).alias("spans"))
    base = F.array_sort(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << c) > 0, label) for c, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda x: x["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)))
    return of_doc.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
