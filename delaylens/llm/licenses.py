"""License scans by diagonal voting, DataFrame expressions only.

All runs of k words of a text are hashed and looked up among the k-grams of the
templates: k is 2 for phrases and short passages and ``Params.gram`` for whole
paragraphs. A hit at word i of the text and place j of a template votes for the
diagonal i - j, the place where the template would begin. Votes are counted by
diagonal; one with a vote for every gram of its template is a whole occurrence.
The others are merged with neighbouring diagonals (words put in or left out move
the rest of a passage by a few) and a merged span counts if it covers enough of
the template within little more than the template's length. What it covers is
verified: the longest run of hits whose template positions rise with their places
in the text, so that a gram counts once however often the text repeats it. Hits
are compared word by word, so a hash that agrees by chance counts for nothing.

The texts are read once; only hits and one row per text are shuffled, grouped
by text; hits of a span that is too long are dropped before a span is collected.
The templates' grams are broadcast while they are at most ``Params.broadcast``
(their number is known on the driver), else they are joined by a shuffle. Defined
results: NULL texts are empty; a text without words has zero counts and empty
labels; repeated rows give one result row each; rows with the same doc_id and
different texts are scanned each on its own; a template shorter than its k is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases whose every occurrence counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Passages that add labels where they occur in whole or in most parts.
PASSAGES = (
    ("permission is hereby granted free of charge", "mit"),
    ("apache license version 2 0", "apache"),
    ("gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by", "cc"),
    ("creative commons attribution", "cc"),
)
#: Whole paragraphs of well-known licences, lower-cased words only; they count by grams of ``Params.gram`` words.
PARAGRAPHS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc"),
)
#: Characters between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    gap: int = 2          # diagonals this near are merged
    coverage: float = 0.6  # least share of a template's grams
    stretch: float = 1.5   # longest span, in lengths of the template
    gram: int = 4          # words of a paragraph's gram
    broadcast: int = 100_000  # grams of the templates, at most, that are broadcast


def templates_of(base=BASE, passages=PASSAGES, paragraphs=PARAGRAPHS, params: Params = Params()) -> list[tuple]:
    """(number, words, label, is base, k) of every template."""
    rows = [(phrase, label, True, 2) for phrase, label in base] + [(phrase, label, False, 2) for phrase, label in passages]
    rows += [(text, label, False, params.gram) for text, label in paragraphs]
    out = [(i, text.split(), label, is_base, k) for i, (text, label, is_base, k) in enumerate(rows)]
    if any(len(words) < k for _, words, _, _, k in out):
        raise ValueError("a template is shorter than its grams")
    return out


PLACE = "array<struct<template:int,label:string,is_base:boolean,k:int,grams:int,at:int>>"


def template_grams(spark, templates: list[tuple], k: int) -> tuple[DataFrame, int]:
    """One row per k-gram of the templates of that k, with all its places; and their number."""
    found: dict[tuple, list] = {}
    for i, words, label, is_base, own in templates:
        if own == k:
            for at in range(len(words) - k + 1):
                found.setdefault(tuple(words[at: at + k]), []).append((i, label, is_base, k, len(words) - k + 1, at))
    rows = [(list(words), places) for words, places in found.items()]
    grams = spark.createDataFrame(rows, f"gram{k} array<string>, places{k} {PLACE}")
    return grams.withColumn(f"hash{k}", F.xxhash64(*[F.col(f"gram{k}")[j] for j in range(k)])), len(rows)


def rising(hits: Column, pairs: Column) -> Column:
    """Most of the hits (pos, back: minus the template position) of which both positions rise together."""

    def longer(best, hit):  # best: for each template position, the longest run that ends there
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), -hit["back"])), F.lit(0))
        return F.transform(best, lambda v, k: F.when(k == -hit["back"], F.greatest(v, before + 1)).otherwise(v))

    # of one place's hits the highest template position comes first, so that no two of them make a run
    return F.aggregate(F.array_sort(hits), F.array_repeat(F.lit(0), pairs), longer, F.array_max)


def scan(documents: DataFrame, base=BASE, passages=PASSAGES, params: Params = Params(), paragraphs=PARAGRAPHS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    spark = documents.sparkSession
    templates = templates_of(base, passages, paragraphs, params)
    kinds = sorted({2, *(k for *_, k in templates)})
    # U+212A is the one character outside ASCII that lower() turns into a letter of ASCII
    lowered = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    texts = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), lowered.alias("text"))
             .select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", BETWEEN).alias("words"))
             .select("doc_id", "text_hash", F.array_remove("words", "").alias("words")))
    # the last word has no second one: its row stands for the text itself
    ahead = [F.slice("words", j + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{j}") for j in range(max(kinds))]
    places = texts.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
                          F.posexplode_outer(F.arrays_zip(*ahead)))
    places = places.select("doc_id", "text_hash", "n_words", "pos", "col.*")
    for k in kinds:
        grams, n = template_grams(spark, templates, k)
        words = [F.col(f"w{j}") for j in range(k)]
        same = F.when(words[-1].isNotNull(), F.xxhash64(*words)) == F.col(f"hash{k}")
        for j, w in enumerate(words):
            same = same & (w == F.col(f"gram{k}")[j])
        places = places.join(F.broadcast(grams) if n <= params.broadcast else grams, same, "left")
    none = F.array().cast(PLACE)
    own_row = F.when(F.col("w1").isNull(), F.array(F.lit(None)).cast(PLACE)).otherwise(none)
    every = F.concat(*[F.coalesce(f"places{k}", none) for k in kinds], own_row)
    hits = (places.select("doc_id", "text_hash", "n_words", "pos", F.explode(every).alias("f"))
            .select("doc_id", "text_hash", "n_words", "pos", "f.*"))
    text = ["doc_id", "text_hash", "n_words"]
    votes = (hits.withColumn("diagonal", F.col("pos") - F.col("at"))
             .groupBy(*text, "template", "label", "is_base", "k", "grams", "diagonal")
             .agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"),
                  F.collect_set("at").alias("ats"))
             .repartition(*text))
    # rows that repeat a text vote as often as they are
    copies = Window.partitionBy(*text)
    votes = (votes.withColumn("copies", F.max(F.when(F.col("template").isNull(), F.col("n"))).over(copies))
             .withColumn("n", F.when(F.col("template").isNotNull(), F.col("n") / F.col("copies")))
             .withColumn("whole", F.coalesce(F.col("n") == F.col("grams"), F.lit(False))))
    along = Window.partitionBy(*text, "template", "whole").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    within = Window.partitionBy(*text, "template", "whole", "span")
    length = F.max("high").over(within) - F.min("low").over(within) + F.col("k")
    points = F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), (-at).alias("back")))
    spans = (votes.withColumn("begins", F.when(F.col("whole") | step.isNull() | (step > params.gap), 1).otherwise(0))
             .withColumn("span", F.sum("begins").over(along))
             # a span that is too long does not count, so its hits are not gathered
             .withColumn("fits", length <= params.stretch * (F.col("grams") + F.col("k") - 1))
             .withColumn("points", F.when(F.col("fits") & ~F.col("whole"), points))
             .groupBy(*text, "copies", "template", "label", "is_base", "grams", "whole", "span", "fits")
             .agg(F.min("diagonal").alias("diagonal"), F.flatten(F.collect_list("points")).alias("hits"))
             .withColumn("covers", F.when(F.col("whole"), F.lit(1.0))
                         .when(F.col("fits"), rising(F.col("hits"), F.col("grams")) / F.col("grams")))
             .withColumn("counts", F.col("whole") | (F.col("fits") & (F.col("covers") >= params.coverage))))
    place = F.when(F.col("is_base") & F.col("whole"), F.col("diagonal").cast("long"))

    def joined(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = spans.groupBy(*text, "copies").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(place.isNotNull()).alias("base_labels"), joined(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("covers"))), F.lit(0.0)).alias("score"))
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), "n_base", "first_word", "last_word",
                    "base_labels", "labels", "score"))


def oracle_sql(base=BASE, passages=PASSAGES, params: Params = Params(), paragraphs=PARAGRAPHS) -> str:
    """The same result in DuckDB, from unnested words and list positions; runs of rising hits by folding over them."""
    values = ", ".join(f"({i}, '{label}', {is_base}, {k}, {words!r})"
                       for i, words, label, is_base, k in templates_of(base, passages, paragraphs, params))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
templates(template, label, is_base, k, phrase) AS (VALUES {values}),
parts AS (
  SELECT template, label, is_base, k, len(phrase) - k + 1 AS grams, j - 1 AS j, array_to_string(phrase[j:j + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(phrase) - k + 2)) AS j FROM templates)),
places AS (
  SELECT r, k, i - 1 AS i, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, k, words, unnest(range(1, len(words) - k + 2)) AS i
        FROM texts, (SELECT DISTINCT k FROM templates) WHERE len(words) >= k)),
votes AS (
  SELECT r, template, label, is_base, k, grams, i - j AS d, count(*) AS n, min(i) AS low, max(i) AS high,
         list({{'i': i, 'back': -j}}) AS points
  FROM places JOIN parts USING (k, gram) GROUP BY ALL),
steps AS (
  SELECT *, n = grams AS whole,
         CASE WHEN d - lag(d) OVER (PARTITION BY r, template, n = grams ORDER BY d) <= {params.gap} AND n <> grams
              THEN 0 ELSE 1 END AS begins
  FROM votes),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY r, template, whole ORDER BY d) AS span FROM steps),
joined AS (
  SELECT r, template, label, is_base, grams, whole, min(d) AS d,
         max(high) - min(low) + k <= {params.stretch} * (grams + k - 1) AS fits, list_sort(flatten(list(points))) AS points
  FROM numbered GROUP BY r, template, label, is_base, k, grams, whole, span),
spans AS (
  SELECT *, CASE WHEN whole THEN 1.0 WHEN fits THEN
    list_max(list_reduce(list_transform(points, lambda p: [-p.back]),
             lambda best, x: list_transform(best, lambda v, m: CASE WHEN m - 1 = x[1]
                                            THEN greatest(v, 1 + coalesce(list_max(best[1:x[1]]), 0)) ELSE v END),
             list_transform(range(grams), lambda z: 0::BIGINT))) / grams END AS covers
  FROM (SELECT * REPLACE (CASE WHEN whole OR NOT fits THEN [] ELSE points END AS points) FROM joined)),
counted AS (SELECT *, whole OR (fits AND covers >= {params.coverage}) AS ok FROM spans),
found AS (
  SELECT r, count(*) FILTER (is_base AND whole) AS n_base, min(d) FILTER (is_base AND whole) AS first_word,
         max(d) FILTER (is_base AND whole) AS last_word,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base AND whole)), ','), '') AS base_labels,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ','), '') AS labels,
         coalesce(max(covers) FILTER (ok), 0.0) AS score
  FROM counted GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN found USING (r)"""
