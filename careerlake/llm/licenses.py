"""Licence phrases, and text blocks that contain a licence template, by an exact set-similarity join.

A block is any run of words of a text, wherever lines end, of at most WIDE times the words of the template it is compared with. A template
is found in a block if at least THRESHOLD of its distinct words stand in it. Only words of templates count towards that, so texts are
reduced to these words and their places first. Words are ordered from rare to frequent over all texts; a block that meets the threshold
has one of the first n - ceil(THRESHOLD * n) + 1 words of a template of n words (prefix filter), so only what stands around such a word
is looked at, for blocks of which it is the rarest word shared. There must be ceil(THRESHOLD * n) words of the template within reach
(length filter), none of them before it in the order (positional filter). Blocks of the candidates are then counted exactly.

DataFrame functions only. A null text counts as empty: no words, no labels, score 0. Words of equal frequency are ordered by
themselves; that changes no result. A very long text is one row, in time and memory in proportion to its length. Repeated rows and
repeated or null ids stay, row for row. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import ascii_lower, cut, table

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
THRESHOLD = 0.8
#: Words of usual notices, and short ones; a parameter.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-short": "licensed under cc by 4 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version",
    "gpl-short": "released under the gnu general public license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-short": "released under the mit license",
    "reserved": "all rights reserved no part may be reproduced without written permission",
}
#: Words of a block, as a multiple of those of the template.
WIDE = 1.5
#: Words of templates in a row that are looked through at a time, besides what they overlap.
STEP = 256
#: Rows of the templates' index that are broadcast; more are joined by shuffles.
INDEX = 100_000
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal(text: Column) -> Column:
    """Words with one blank around each, or one blank alone."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), NO_WORD, " ")
    return spaced


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, phrase: str) -> Column:
    """How often the phrase stands, and the numbers of the words where it does first and last; words as from normal()."""
    n = len(phrase.split())
    steps = F.transform(F.split(words, f" {phrase}(?= )"), blanks)
    # bound to a variable, else each field would split the text anew
    found = F.transform(F.array(steps), lambda b: F.struct((F.size(b) - 1).alias("n"), b[0].alias("first"), (F.aggregate(b, F.lit(0), lambda a, x: a + x) - F.element_at(b, -1) + (F.size(b) - 2) * n).alias("last")))
    return F.when(F.contains(words, F.lit(f" {phrase} ")), found[0])


def pieces(known: Column, reach: int, least: int) -> Column:
    """known (place, word) in pieces of STEP, each as the words that are its own and these with `reach` more on both sides, if `least` of them are distinct."""
    begins = F.when(F.size(known) > 0, F.sequence(F.lit(1), F.size(known), F.lit(STEP)))

    def piece(b: Column) -> Column:
        low = F.greatest(F.lit(1), b - reach)
        return F.struct(F.slice(known, b, STEP).alias("own"), F.slice(known, low, b + STEP + reach - low).alias("wide"))

    return F.filter(F.transform(begins, piece), lambda p: F.size(F.array_distinct(F.transform(p["wide"], lambda y: y["word"]))) >= least)


def around(own: Column, wide: Column, anchors: list[str], reach: int, least: int) -> Column:
    """For each of the words of `anchors` in own: its place, itself, and what of wide is less than `reach` words away, if `least` distinct words are."""

    def near(x: Column) -> Column:
        return F.filter(wide, lambda y: F.abs(y["place"] - x["place"]) < reach)

    # tested first, so that no more is held than is wanted
    spots = F.filter(own, lambda x: x["word"].isin(anchors) & (F.size(F.array_distinct(F.transform(near(x), lambda y: y["word"]))) >= least))
    return F.transform(spots, lambda x: F.struct(x["place"].alias("at"), x["word"].alias("token"), near(x).alias("near")))


def fullest(near: Column, at: Column, width: Column) -> Column:
    """Most distinct words of near in any block of `width` words that holds place `at`; blocks begin at one of near."""
    starts = F.filter(near, lambda s: (s["place"] <= at) & (s["place"] > at - width))
    count = lambda s: F.size(F.array_distinct(F.transform(F.filter(near, lambda x: (x["place"] >= s["place"]) & (x["place"] < s["place"] + width)), lambda x: x["word"])))
    return F.array_max(F.transform(starts, count))


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score is the largest share of a template's words that a block which meets the threshold contains, or 1 where a phrase stands.
    """
    texts = templates if templates is not None else TEMPLATES
    sets = {label: sorted(set(words.split())) for label, words in texts.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    need = {label: math.ceil(round(threshold * len(s), 9)) for label, s in sets.items()}
    width = {label: math.ceil(WIDE * len(words.split())) for label, words in texts.items()}

    lower = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    words = normal(F.col("__lower"))
    by_phrase = [F.col(f"__p{k}") for k in range(len(PHRASES))]
    found = F.struct(
        sum(F.coalesce(p["n"], F.lit(0)) for p in by_phrase).cast("long").alias("n"),
        F.array_min(F.array(*(p["first"] for p in by_phrase))).cast("long").alias("first"),
        F.array_max(F.array(*(p["last"] for p in by_phrase))).cast("long").alias("last"),
    )
    base = (
        docs.select("doc_id", lower.alias("__lower"))
        .withColumn("__words", words)
        .withColumns({f"__p{k}": places(F.col("__words"), p) for k, p in enumerate(PHRASES)})
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (blanks(F.col("__words")) - 1).cast("long").alias("n_words"),
            found.alias("found"),
            F.array_sort(F.filter(F.array(*(F.when(p.isNotNull(), F.lit(label)) for p, label in zip(by_phrase, PHRASES.values()))), lambda x: x.isNotNull())).alias("base"),
            F.filter(F.transform(F.split(F.col("__words"), " "), lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda x: x["word"].isin(vocabulary)).alias("known"),
        )
    )
    base = cut(base)

    frequency = base.select(F.explode("known.word").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # at most a row for each word of the templates
    ranked = {r["word"]: i for i, r in enumerate(frequency.orderBy("n", "word").collect())}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (ranked.get(w, -1), w)))}
    prefixes = []
    for label, s in sets.items():
        ordered = sorted(s, key=rank.__getitem__)
        for place, w in enumerate(ordered[: len(s) - need[label] + 1]):
            prefixes.append((w, label, ordered[place:], need[label], len(s), width[label]))
    spark = docs.sparkSession
    index = spark.createDataFrame(prefixes, "token string, label string, rest array<string>, need int, size int, width int")
    index = F.broadcast(index) if len(prefixes) <= INDEX else index

    anchors, reach, least = sorted({p[0] for p in prefixes}), max(width.values(), default=1), min(need.values(), default=1)
    parts = base.select("row", F.explode(pieces(F.col("known"), reach, least)).alias("p"))
    probes = parts.select("row", F.explode(around(F.col("p.own"), F.col("p.wide"), anchors, reach, least)).alias("r")).select("row", "r.*")
    near = F.filter("near", lambda x: (F.abs(x["place"] - F.col("at")) < F.col("width")) & F.array_contains("rest", x["word"]))
    close = probes.join(index, "token").select("row", "label", "need", "size", "width", "at", near.alias("near"))
    close = close.filter(F.size(F.array_distinct("near.word")) >= F.col("need"))
    shared = fullest(F.col("near"), F.col("at"), F.col("width"))
    hits = close.select("row", "label", "need", "size", shared.alias("shared")).filter("shared >= need").select("row", "label", (F.col("shared") / F.col("size")).alias("share"))
    by_row = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))  # at most a label for each template

    joined = base.drop("known").join(by_row, "row", "left")
    n = F.col("found.n")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.col("found.first").alias("first_word"),
        F.col("found.last").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """The same by comparing every block that begins with a word of a template with it."""
    no_word = NO_WORD.replace("\\\\", "\\")
    places_ = " UNION ALL ".join(
        f"""SELECT row, '{label}' AS label, i - 1 AS spot FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE contains(text, '{phrase.split()[-1]}'))
        WHERE {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))}"""
        for phrase, label in PHRASES.items()
    )
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))}, {math.ceil(round(THRESHOLD * len(set(t.split())), 9))}, {math.ceil(WIDE * len(t.split()))})" for label, t in TEMPLATES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, doc_id, text, list_filter(regexp_split_to_array(text, '{no_word}'), lambda x: x <> '') AS w FROM docs),
places AS ({places_}),
base AS (SELECT row, count(*) AS n, min(spot) AS a, max(spot) AS b, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY row),
templates(label, t, need, width) AS (VALUES {rows}),
starts AS (SELECT row, label, t, need, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS i, width FROM words, templates WHERE len(list_intersect(w, t)) >= need),
hits AS (SELECT row, label, n / len(t) AS share FROM (SELECT row, label, t, need, len(list_intersect(w[i:i + width - 1], t)) AS n FROM starts JOIN words USING (row)) WHERE n >= need),
more AS (SELECT row, list(DISTINCT label) AS labels, max(share) AS share FROM hits GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (row) LEFT JOIN more USING (row)"""


QUERIES = {"op5_license_scan": op5_license_scan}
SQL = {"op5_license_scan": oracle()}
