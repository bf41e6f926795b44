"""License scans by diagonal voting: DataFrame functions only, no Python on the main path.

A text's words are the runs of ASCII letters and digits (lower-cased) and characters from U+0080
on. All rolling word k-grams of the texts meet the k-grams of the templates in a join on their
hashes; the words are compared again, so a hash that two grams share cannot count. A gram at
word ``i`` of a text and word ``j`` of a template votes for the diagonal ``i - j``. Votes of a
diagonal are a bit set over ``j``, so they combine before the shuffle and equal texts vote once.

- Phrases (``PHRASES``, k = 2) stand where a diagonal has every vote of the phrase.
- Texts (``TEXTS``, k = 3): diagonals of at least ``MIN_VOTES`` votes that lie at most ``MAX_SHIFT``
  words apart are one span, which bridges inserted and left-out words. A span is verified if it
  holds at least ``MIN_SHARE`` of the template's grams and is at most ``MAX_STRETCH`` times as long.

The templates are constants of a few hundred words in all, so the join broadcasts them whatever the
corpus. Matches are grouped by the text's digest: a copied text is one group of combined votes.
They rest in the shared folder and go back to the documents by a join whose right side has unique
keys and no grouping of its own, so that the planner may split a digest that very many documents have.

Edge cases: a null text is empty; a text without words has no places and null ``first_word`` and
``last_word``; without a label the label columns are the empty string and ``score`` is 0; places
may overlap and all count; rows that repeat a doc_id are scanned on their own; other columns are
ignored; an empty table gives an empty result. ``score`` is 1 with a phrase, else the best
verified share. (``lower`` makes the Kelvin sign an ASCII k, which no phrase contains.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 63  # votes a long column holds
MIN_VOTES = 2
MAX_SHIFT = 8
MIN_SHARE = 0.5
MAX_STRETCH = 2.0
PHRASE_GRAM, TEXT_GRAM = 2, 3

# Phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Standard notices and license passages and their labels.
TEXTS: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _grams(df: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per word of ``words``: its place ``i``, itself and the two after it (null at the end)."""
    def after(n: int) -> Column:
        return F.slice("words", n + 1, F.greatest(F.size("words") - n, F.lit(0)))
    shifted = F.arrays_zip(F.col("words").alias("w0"), after(1).alias("w1"), after(2).alias("w2"))
    return (df.select(*keep, F.posexplode(shifted).alias("i", "_g"))
            .select(*[c for c in df.columns if c in keep], "i", "_g.w0", "_g.w1", "_g.w2"))


def _hash(k: int) -> Column:
    """The hash of the k-gram at a word; null where the text ends before."""
    some = [F.col(f"w{n}") for n in range(k)]
    return F.when(some[-1].isNotNull(), F.xxhash64(*some))


def templates(spark: SparkSession, some: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(t, label, n_grams, j, w0..w2): the k-grams of the templates, ``t`` numbering them."""
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(text).alias("text"))
                     for t, (label, text) in enumerate(some)])
    words = (spark.range(1).select(F.inline(rows))
             .withColumn("words", _words(F.col("text"))).withColumn("n_grams", F.size("words") - F.lit(k - 1)))
    return (_grams(words, "t", "label", "n_grams").withColumnRenamed("i", "j")
            .where(F.col(f"w{k - 1}").isNotNull()))


def _lookup(spark: SparkSession, some: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(h<k>, at<k>): for each gram hash its places in the templates; a few hundred rows at most."""
    place = F.struct("t", "j", "n_grams", *[F.col(f"w{n}").alias(f"t{n}") for n in range(k)])
    return (templates(spark, some, k).groupBy(_hash(k).alias(f"h{k}"))
            .agg(F.sort_array(F.collect_list(place)).alias(f"at{k}")))


def _lanes(some: tuple[tuple[str, str], ...]) -> int:
    """Number of long columns that hold a bit for each word of the longest template."""
    return max(len(text.split()) * 2 for _, text in some) // BITS + 1


def _votes(grams: DataFrame, k: int, lanes: int) -> DataFrame:
    """(digest, t, n_grams, diagonal, v0..): bit sets of the template words that voted."""
    same = reduce(lambda a, b: a & b, [F.col(f"w{n}") == F.col(f"_at.t{n}") for n in range(k)])
    j = F.col("_at.j")
    return (grams.select("digest", "i", "w0", "w1", "w2", F.explode(f"at{k}").alias("_at")).where(same)
            .groupBy("digest", F.col("_at.t").alias("t"), F.col("_at.n_grams").alias("n_grams"),
                     (F.col("i") - j).alias("diagonal"))
            .agg(*[F.bit_or(F.when(F.floor(j / BITS) == n, F.expr(f"shiftleft(1L, cast(_at.j % {BITS} as int))"))
                            .otherwise(F.lit(0).cast("long"))).alias(f"v{n}") for n in range(lanes)]))


def _count(lanes: int) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(f"v{n}") for n in range(lanes)])


def _edge(lanes: int, last: bool) -> Column:
    """The first or last template word that voted."""
    order = range(lanes - 1, -1, -1) if last else range(lanes)
    def within(n: int) -> str:
        low = f"v{n}" if last else f"v{n} & -v{n}"
        return f"length(bin({low})) - 1 + {n * BITS}"
    return F.coalesce(*[F.expr(f"if(v{n} <> 0, {within(n)}, null)") for n in order])


def spans(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, texts: tuple[tuple[str, str], ...] = TEXTS,
          text: str = "text") -> DataFrame:
    """(digest, base, label, first_word, end_word, share): the places of phrases (``base``) and the
    verified spans of license texts, per digest of a text."""
    spark = docs.sparkSession
    stream = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    grams = (_grams(stream.select(F.md5("_text").alias("digest"), _words(F.col("_text")).alias("words")), "digest")
             .withColumn("h2", _hash(PHRASE_GRAM)).withColumn("h3", _hash(TEXT_GRAM)))

    def met(some: tuple[tuple[str, str], ...], k: int) -> DataFrame:
        # The lookup is made of constants: its size has nothing to do with the data's.
        return grams.join(F.broadcast(_lookup(spark, some, k)), f"h{k}")

    lanes = _lanes(phrases)
    labels = F.create_map(*[F.lit(x) for t, (label, _) in enumerate(phrases) for x in (t, label)])
    placed = (_votes(met(phrases, PHRASE_GRAM), PHRASE_GRAM, lanes).where(_count(lanes) == F.col("n_grams"))
              .select("digest", F.lit(True).alias("base"), F.element_at(labels, F.col("t")).alias("label"),
                      F.col("diagonal").alias("first_word"),
                      (F.col("diagonal") + F.col("n_grams") + PHRASE_GRAM - 1).alias("end_word"),
                      F.lit(1.0).alias("share")))

    lanes = _lanes(texts)
    labels = F.create_map(*[F.lit(x) for t, (label, _) in enumerate(texts) for x in (t, label)])
    voted = _votes(met(texts, TEXT_GRAM), TEXT_GRAM, lanes).where(_count(lanes) >= MIN_VOTES)
    along = Window.partitionBy("digest", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MAX_SHIFT, F.lit(True))
    merged = (voted.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(along))
              .withColumn("_first", F.col("diagonal") + _edge(lanes, last=False))
              .withColumn("_end", F.col("diagonal") + _edge(lanes, last=True) + TEXT_GRAM)
              .groupBy("digest", "t", "n_grams", "_span")
              .agg(F.min("_first").alias("first_word"), F.max("_end").alias("end_word"),
                   *[F.bit_or(f"v{n}").alias(f"v{n}") for n in range(lanes)])
              .withColumn("share", _count(lanes) / F.col("n_grams")))
    length = F.col("end_word") - F.col("first_word")
    verified = (merged.where((F.col("share") >= MIN_SHARE) &
                             (length <= MAX_STRETCH * (F.col("n_grams") + TEXT_GRAM - 1)))
                .select("digest", F.lit(False).alias("base"), F.element_at(labels, F.col("t")).alias("label"),
                        "first_word", "end_word", "share"))
    return placed.unionByName(verified)


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ",")


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, texts: tuple[tuple[str, str], ...] = TEXTS,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("base")
    found = spans(docs, phrases, texts, text).groupBy("digest").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        _joined(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    path = scratch_path(docs.sparkSession, "licenses")
    found.write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(whole).alias("digest"),
                        F.size(_words(whole)).cast("long").alias("n_words"))
    return sized.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
