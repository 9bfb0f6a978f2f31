"""Find license notices: fixed phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a line, or a window of a long line or of the words of the whole text, whatever its line ends; windows overlap so
that any run of ``STEP`` words lies in one.
A block matches a template if it holds at least ``threshold`` of the template's distinct words.

Only words of some template can add to an overlap, so blocks are reduced to these when the text is
read.  Words are numbered by their frequency over all blocks, rarest first.  A block that matches must hold one of a
template's first |T| - need + 1 words (prefix filter) and at least ``need`` words (length filter), and after a
shared word at places i and j no more than min(|T| - i, |B| - j) can be shared (positional filter).
What passes is verified on the sets.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import fresh, stored, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Usual wordings of notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This work is dedicated to the public domain"),
)
THRESHOLD = 0.9
STEP = 24


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted(set(re.findall(WORD, text.lower())))) for label, text in templates]


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers where the words of ``phrase`` stand one after another."""
    first, *rest = phrase.split(" ")

    def here(w: Column, i: Column) -> Column:
        hit = w == first
        for k, other in enumerate(rest, 1):
            hit = hit & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def scan(
    docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES, step: int = STEP, text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest containment of a template among the matching blocks, and 1 where a base phrase stands.
    Null and empty texts have no words, labels "" and score 0.  Repeated rows each get a row.
    ``step`` must not be below the longest template's word count.
    """
    sets = template_sets(templates)
    if any(len(t.split()) > step for _, t in templates):
        raise ValueError("a template is longer than step words")
    vocabulary = sorted({w for _, ws in sets for w in ws})
    least = min(math.ceil(threshold * len(ws)) for _, ws in sets)
    known = F.array(*[F.lit(w) for w in vocabulary])
    low, lines, words, held = fresh("low"), fresh("lines"), fresh("words"), fresh("held")
    any_phrase = "|".join(GAP.join(p.split(" ")) for p, _ in phrases)
    has = F.rlike(F.col(low), F.lit(any_phrase))
    starts = [F.when(has, _phrase_starts(F.col(words), p)).otherwise(F.array().cast("array<int>")) for p, _ in phrases]
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    found = F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])

    def windows(ws: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(step)), lambda i: F.slice(ws, i + 1, F.lit(2 * step)))
        inner = F.when(F.size(ws) > 2 * step, cut).otherwise(F.array(ws))
        reduced = F.transform(inner, lambda b: F.array_intersect(b, known))
        return F.when(F.size(F.array_intersect(ws, known)) >= least, F.filter(reduced, lambda b: F.size(b) >= least)).otherwise(
            F.array().cast("array<array<string>>")
        )

    # a notice may be broken over lines
    wrapped = F.when(F.size(lines) > 1, windows(F.col(words))).otherwise(F.array().cast("array<array<string>>"))
    # no block holds more of a template than its text does
    needs = [(F.array(*[F.lit(w) for w in ws]), math.ceil(threshold * len(ws))) for _, ws in sets]
    possible = F.exists(
        F.array(*[F.struct(ws.alias("words"), F.lit(need).alias("need")) for ws, need in needs]),
        lambda t: F.size(F.array_intersect(F.col(held), t["words"])) >= t["need"],
    )
    numbered = lambda b: F.transform(b, lambda w: F.array_position(known, w).cast("int"))
    rows = (
        docs.select("doc_id", F.lower(text_of(text)).alias(low))
        .withColumn(lines, F.transform(F.split(low, "\n"), lambda line: _words(line)))
        .withColumn(words, F.flatten(lines))
        .withColumn(held, F.array_intersect(words, known))
        .withColumns({f"_p{k}": s for k, s in enumerate(starts)})
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("_row"),
            F.size(words).cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_sort(F.array_compact(found)).alias("base"),
            F.when(possible, F.transform(F.array_distinct(F.concat(F.flatten(F.transform(lines, windows)), wrapped)), numbered))
            .otherwise(F.array().cast("array<array<int>>"))
            .alias("blocks"),
        )
    )
    rows = stored(rows, "license-blocks")
    matched = _matches(rows.where(F.size("blocks") > 0).select("_row", F.explode("blocks").alias("block")), sets, vocabulary, threshold)
    labelled = matched.groupBy("_row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    return rows.drop("blocks").join(labelled, "_row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _matches(blocks: DataFrame, sets: list[tuple[str, list[str]]], vocabulary: list[str], threshold: float) -> DataFrame:
    """(_row, label, containment) of the best matching block of each label; ``block`` holds word numbers from 1."""
    spark = blocks.sparkSession
    # one count for each word of the templates, whatever the input
    counts = {r["w"]: r["count"] for r in blocks.select(F.explode("block").alias("w")).groupBy("w").count().collect()}
    order = sorted(range(1, len(vocabulary) + 1), key=lambda n: (counts.get(n, 0), n))
    rank = {n: k for k, n in enumerate(order)}
    ranks = F.array(*[F.lit(rank[n]) for n in range(1, len(vocabulary) + 1)])
    number = {w: n for n, w in enumerate(vocabulary, 1)}
    prefixes = []
    for label, words in sets:
        ordered = sorted(rank[number[w]] for w in words)
        need = math.ceil(threshold * len(ordered))
        prefixes += [(word, label, i, ordered, need) for i, word in enumerate(ordered[: len(ordered) - need + 1])]
    table = spark.createDataFrame(prefixes, "word int, label string, i int, template array<int>, need int")
    first = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
    ranked = blocks.select("_row", F.array_sort(F.transform("block", lambda n: F.element_at(ranks, n))).alias("block"))
    candidates = (
        ranked.where(F.arrays_overlap("block", first))
        .select("_row", "block", F.posexplode("block").alias("j", "word"))
        .join(F.broadcast(table), "word")  # a row for each prefix word of the fixed templates
        .where(F.size("block") >= F.col("need"))
        .where(F.least(F.size("template") - F.col("i"), F.size("block") - F.col("j")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("block", "template"))
    return (
        candidates.where(shared >= F.col("need"))
        .groupBy("_row", "label")
        .agg(F.max(shared / F.size("template")).alias("containment"))
    )
