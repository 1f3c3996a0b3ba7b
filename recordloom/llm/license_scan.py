"""License scan: places of licence phrases, and an exact set-similarity join of text blocks with
licence templates. DataFrame functions only.

Join: a block (a line, or a window of as many consecutive words of the text as the template has,
so that line breaks don't matter) and a template are sets of words. The template containment is the share of
the template's words that the block has; pairs of CONTAINMENT or more are found, all of them.
Template words are ordered by their number of blocks in the corpus, rare ones first. A pair that
shares c or more of a template's t words shares one of the template's first t - c + 1, and its
first shared word is among the block's first b - c + 1 template words (prefix filters); blocks
of fewer template words than c drop out (length); a meeting leaves c only if enough words follow
on both sides (positional). What is left is verified by intersecting the sets.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows and equal
ids each get their row; without templates only the phrases count; of phrases that overlap each other
(none of PHRASES do) the first from the left is a place; a very long text is searched whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, sorted_join, stored

#: Fixed values of the contract: phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates of the join, name and words: the usual one-line notices and headers (fixed values).
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-4.0": "licensed under the creative commons attribution 4.0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "copyright": "all rights reserved copyright",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}
CONTAINMENT = 0.8
#: Templates are broadcast up to so many (word, template) rows, else the join shuffles both sides.
BROADCAST_ROWS = 200_000

#: A word's characters, [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F], and the others. Java runs these classes ten times as fast as ranges.
_WORD, _GAP = "[\\p{Alnum}\\P{ASCII}]", "[^\\p{Alnum}\\P{ASCII}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({_WORD}++)"), 1)


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_WORD}++")).cast("long")


def phrase_columns(text: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word, found (labels): a place is where a phrase's words stand in a row.

    The text between places is counted in words, so positions need no word array."""
    body = "|".join(f"{_GAP}++".join(p.split()) for p in phrases)
    pattern = f"(?i)(?<!{_WORD})(?:{body})(?!{_WORD})"
    places = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    tail = count_words(F.element_at(between, -1)) + count_words(F.element_at(places, -1))

    def stands(phrase: str) -> Column:
        whole = "(?i)^" + f"{_GAP}++".join(phrase.split()) + "$"
        return F.exists(places, lambda x: x.rlike(whole))

    labels = F.array(*(F.when(stands(p), F.lit(label)) for p, label in phrases.items()))
    # Texts without a phrase's longest word needn't be searched for it.
    low = F.lower(text)
    may = reduce(or_, (low.contains(max(p.split(), key=len)) for p in phrases), F.lit(False))
    any_ = may & text.rlike(pattern)
    return {
        "n_base": F.when(any_, F.size(places).cast("long")).otherwise(F.lit(0).cast("long")),
        "first_word": F.when(any_, count_words(F.element_at(between, 1))),
        "last_word": F.when(any_, count_words(text) - tail),
        "found": F.when(any_, F.filter(labels, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")),
    }


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, words (distinct), length (in words, repeated ones too)."""
    rows = [(name, text) for name, text in templates.items()]
    one = spark.createDataFrame(rows, "template string, text string")
    return one.select("template", F.array_distinct(words(F.col("text"))).alias("words"), F.size(words(F.col("text"))).alias("length")).where(F.size("words") > 0)


def containments(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """key, block (line number), template, share: every pair of the threshold or more. docs: key, text."""
    needed = F.ceil(F.lit(containment) * F.size("words") - F.lit(1e-9)).cast("int")
    sized = templates.withColumn("need", F.greatest(needed, F.lit(1)))
    vocabulary = sized.select(F.explode("words").alias("w")).distinct()
    summed = sized.agg(F.min("need").alias("least"), F.sum(F.size("words")).alias("n")).first()
    if not summed["n"]:
        return docs.select("key", F.lit(0).alias("block"), F.lit("").alias("template"), F.lit(0.0).alias("share")).where("false")
    small = summed["n"] <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)
    # Words of lines that are template words. Lines too short for any template leave before they are cut up.
    blocks = docs.select("key", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("block", "line"))
    if small:
        # A pair may miss t - c words of a template, so it has one of any t - c + 1; the longest make the narrowest filter.
        rows = sized.select("words", "need").collect()  # at most BROADCAST_ROWS words
        probe = {w for r in rows for w in sorted(r["words"], key=lambda w: (-len(w), w))[: len(r["words"]) - r["need"] + 1]}
        blocks = blocks.where(F.col("line").rlike(f"(?i)(?<!{_WORD})(?:{'|'.join(sorted(map(_quoted, probe)))})(?!{_WORD})"))
    cut = blocks.select("key", "block", F.array_distinct(words(F.col("line"))).alias("ws")).where(F.size("ws") >= summed["least"])
    met = cut.select("key", "block", F.explode("ws").alias("w")).join(sent(vocabulary), "w")
    found = stored(met, "license-words")
    order = stored(vocabulary.join(found.groupBy("w").agg(F.count("*").alias("df")), "w", "left").select("w", F.coalesce("df", F.lit(0)).alias("df")), "license-order")
    ranked = F.array_sort(F.collect_list(F.struct("df", "w")))
    block_sets = found.join(sent(order), "w").groupBy("key", "block").agg(ranked.alias("b")).where(F.size("b") >= summed["least"])
    template_sets = sized.select("template", "need", F.explode("words").alias("w")).join(order, "w").groupBy("template", "need").agg(ranked.alias("t"))
    prefix = template_sets.select("template", "need", "t", F.posexplode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("i", "x")).select("template", "need", "t", "i", "x.w")
    probes = block_sets.select("key", "block", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - summed["least"] + 1)).alias("j", "x")).select("key", "block", "b", "j", "x.w")
    left = 1 + F.least(F.size("t") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    candidates = probes.join(sent(prefix), "w").where((F.size("b") >= F.col("need")) & (left >= F.col("need")))
    share = F.size(F.array_intersect("b", "t"))
    return candidates.withColumn("common", share).where("common >= need").select("key", "block", "template", (F.col("common") / F.size("t")).alias("share")).distinct()


def wrapped(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """key, template, share: the pairs of the threshold or more in windows of consecutive words, across lines. docs: key, text."""
    sized = templates.withColumn("need", F.greatest(F.ceil(F.lit(containment) * F.size("words") - F.lit(1e-9)).cast("int"), F.lit(1))).withColumn("t", F.size("words"))
    summed = sized.agg(F.max("length").alias("most"), F.sum("t").alias("n")).first()
    if not summed["n"]:
        return docs.select("key", F.lit("").alias("template"), F.lit(0.0).alias("share")).where("false")
    small = summed["n"] <= BROADCAST_ROWS
    texts = docs.where(F.col("text").contains("\n"))
    if small:
        # As for lines: a text without any of these words has no template.
        rows = sized.select("words", "need").collect()  # at most BROADCAST_ROWS words
        probe = {w for r in rows for w in sorted(r["words"], key=lambda w: (-len(w), w))[: len(r["words"]) - r["need"] + 1]}
        texts = texts.where(F.col("text").rlike(f"(?i)(?<!{_WORD})(?:{'|'.join(sorted(map(_quoted, probe)))})(?!{_WORD})"))
    met = sized.select("template", "need", "t", "length", F.explode("words").alias("w"))
    found = texts.select("key", "text").distinct().select("key", F.posexplode(words(F.col("text"))).alias("pos", "w")).join(F.broadcast(met) if small else met, "w")
    near = F.collect_list(F.struct("pos", "w")).over(Window.partitionBy("key", "template").orderBy("pos").rangeBetween(0, summed["most"] - 1))
    inside = F.filter(F.col("near"), lambda x: x["pos"] < F.col("pos") + F.col("length"))
    common = F.size(F.array_distinct(F.transform(inside, lambda x: x["w"])))
    counted = found.withColumn("near", near).select("key", "template", "need", "t", common.alias("common")).where("common >= need")
    return counted.groupBy("key", "template").agg(F.max(F.col("common") / F.col("t")).alias("share"))


def _quoted(word: str) -> str:
    return "\\Q" + word.replace("\\E", "") + "\\E"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of docs.

    score: 1 where a phrase stands, else the largest containment found (0 where none reaches the threshold)."""
    rows = keyed(docs, id_col, text_col)
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    texts = rows.select("key", "text")
    shares = containments(texts, table, containment).select("key", "template", "share").unionByName(wrapped(texts, table, containment))
    best = shares.groupBy("key").agg(F.array_sort(F.collect_set("template")).alias("more"), F.max("share").alias("share"))
    base = rows.select("doc_id", "key", count_words(F.col("text")).alias("n_words"), *(c.alias(n) for n, c in phrase_columns(F.col("text")).items()))
    none = F.array().cast("array<string>")
    joined = base.join(best, "key", "left")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", sorted_join(F.col("found")).alias("base_labels"), sorted_join(F.concat("found", F.coalesce("more", none))).alias("labels"), score.alias("score"))
