"""License scan by voting on diagonals.

Every run of k words of a text that a template has, at text position p and template position t,
votes for the diagonal p - t: a copied template is a diagonal full of votes, and a word added or lost
moves the rest to a neighbouring one. Votes are counted by diagonal before anything is shuffled,
neighbouring diagonals are merged, and a span counts when the words themselves (not their hashes)
cover enough of the template's runs. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_sized, lower_ascii

K = 3
# Diagonals this far apart are merged: so many words may be added or lost inside a span.
SLACK = 4
# Percent of a template's runs that a span must have.
COVER = 80
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Notices by which texts are licensed, as their publishers word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
)


def license_words(text: Column) -> Column:
    """Words of letters and digits, A-Z lower-cased; all of Unicode beyond ASCII belongs to words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), lambda w: w != "")


def _runs(words: Column, k: int) -> Column:
    """(at, gram) of every run of k words."""
    none = F.array().cast("array<struct<at:int,gram:string>>")

    def run(i):
        gram = F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
        return F.struct(i.alias("at"), gram.alias("gram"))

    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), run)).otherwise(none)


def template_runs(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(hash, gram, template, label, t_at, n_runs) of every run of every template.

    A template of fewer than k words has no runs and is never found.
    """
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    given = spark.createDataFrame(rows, "template int, label string, text string")
    split = given.select("template", "label", license_words(F.col("text")).alias("w"))
    runs = split.select("template", "label", F.explode(_runs(F.col("w"), k)).alias("r"), (F.size("w") - k + 1).alias("n_runs"))
    return runs.select(
        F.xxhash64("r.gram").alias("hash"), F.col("r.gram").alias("gram"), "template", "label",
        F.col("r.at").alias("t_at"), "n_runs",
    )


def license_spans(
    docs: DataFrame, templates=TEMPLATES, k: int = K, slack: int = SLACK, cover: int = COVER,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Where templates stand in texts: doc_id, text_hash, template, label, first, last, n_covered, n_runs.

    ``docs`` has doc_id and text; other columns are ignored. first and last are the first and last
    word of a span; n_covered of the template's n_runs runs are in it, at least ``cover`` percent. Of
    overlapping alignments of one template the one that covers most is kept, the earliest of equal
    ones. Rows with one doc_id and one text give their spans once. Null and empty texts give none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    runs = scratch.write(template_runs(spark, templates, k), "template_runs")
    key = ["doc_id", "text_hash"]
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("w"))
    each = split.select(*key, F.explode(_runs(F.col("w"), k)).alias("r")).select(
        *key, F.col("r.at").alias("at"), F.col("r.gram").alias("gram"), F.xxhash64("r.gram").alias("hash")
    )
    met = join_sized(each, runs, ["hash", "gram"], "inner", scratch, "template_runs")
    votes = met.groupBy(*key, "template", "label", "n_runs", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.collect_set("t_at").alias("t_at")  # at most the runs of a template
    )
    by = W.partitionBy(*key, "template").orderBy("diagonal")
    band = by.rangeBetween(0, slack)
    ends = F.array_max("t_at") + F.col("diagonal") + (k - 1)
    merged = votes.select(
        "*",
        F.size(F.array_distinct(F.flatten(F.collect_list("t_at").over(band)))).alias("n_covered"),
        F.min(F.array_min("t_at") + F.col("diagonal")).over(band).alias("first"),
        F.max(ends).over(band).alias("last"),
    ).where(100 * F.col("n_covered") >= cover * F.col("n_runs"))
    before = F.coalesce(F.max("n_covered").over(by.rangeBetween(-slack, -1)), F.lit(0))
    after = F.coalesce(F.max("n_covered").over(by.rangeBetween(1, slack)), F.lit(0))
    return (
        merged.withColumn("best", (F.col("n_covered") > before) & (F.col("n_covered") >= after))
        .where("best")
        .select(*key, "template", "label", "first", "last", "n_covered", "n_runs")
    )


def phrase_places(words: Column, text: Column, phrase: str) -> Column:
    """The places where the words of ``phrase`` stand in ``words``, the words of ``text``."""
    parts = phrase.split(" ")

    def here(i):
        # The last word is the rarest of the known phrases; the others are only looked at where it is.
        test = F.get(words, i + len(parts) - 1) == parts[-1]
        for j, part in enumerate(parts[:-1]):
            test = test & (F.get(words, i + j) == part)
        return test

    may = F.contains(lower_ascii(text), F.lit(parts[-1])) & (F.size(words) >= len(parts))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(may, places).otherwise(F.array().cast("array<int>"))


def license_scan(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, slack: int = SLACK, cover: int = COVER,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per document: n_words, the places of license phrases, labels and a score.

    Columns: doc_id, n_words, n_base (all places of phrases), first_word and last_word (their
    smallest and largest start, words from 0; null without one), base_labels and labels (distinct,
    sorted, comma-joined; labels has those of template spans too) and score: the largest share of a
    template that a span covers, at least 0.5 where a phrase stands, else 0. A row with a null or
    empty text has no words and no labels; equal rows give equal results; an empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spans = license_spans(docs, templates, k, slack, cover, scratch)
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max(F.col("n_covered") / F.col("n_runs")).alias("share")
    )
    found = scratch.write(found.withColumnsRenamed({"doc_id": "f_id", "text_hash": "f_hash"}), "license_found")
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), license_words(text).alias("w"))
    placed = split.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"),
        *[phrase_places(F.col("w"), F.col("text"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)],
    )
    names = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]
    every = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    base = placed.select("doc_id", "text_hash", "n_words", every.alias("places"), F.array_compact(F.array(*names)).alias("base"))
    small = scratch.size("license_found") <= 16 << 20
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash"))
    joined = base.join(F.broadcast(found) if small else found, same, "left")
    none = F.array().cast("array<string>")
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.greatest(
            F.coalesce("share", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
        ).alias("score"),
    )
