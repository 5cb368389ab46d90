r"""Operator 9 [native]: license phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A-Z are lower-cased; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. Base: places where a phrase's words stand
in a row, whatever stands between them.

Join: a block is a run of 2 REACH words that starts at a multiple of REACH words, so a license text of up to REACH words, on one
line or wrapped over many, lies whole in a block. A template is a set of words, of at most REACH words of text. They match if
the block holds CONTAINMENT of the template's words; of templates of at most SHORT words, all. Words of templates are ordered
by how often the corpus has them, rarest first. A block that holds `need` of a template's t words
  prefix      holds one of its t - need + 1 rarest,
  length      has at least `need` template words at all, and
  position    at one of these shared words, i-th of the template and j-th of the block, both have enough words left.
What passes the three filters is counted in full, so every match is found and nothing else. Only the templates' words are ever
compared, and the templates are a parameter of bounded size, so the index is a literal of the plan and no text is shuffled.

A null text counts as empty. Null doc_ids and rows that repeat stay; extra columns are left out.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

CONTAINMENT, SHORT, REACH = 0.8, 8, 80
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Sentences of public licenses: the label, and the words in their order.
TEMPLATES = [
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _needed(templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """Label, set of words, how many of them a block needs."""
    out = []
    for label, text in templates:
        if len(text.split()) > REACH:
            raise ValueError(f"a template of {label} has over {REACH} words: part it")
        words = list(dict.fromkeys(text.split()))
        out.append((label, words, len(words) if len(words) <= SHORT else math.ceil(CONTAINMENT * len(words))))
    return out


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _line(text: Column) -> Column:
    """Words with a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _BETWEEN, " ")), F.lit(" "))


def _lower(text) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def frequencies(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """How often the corpus has each word of the templates: one row of a fixed set for each reaches the driver."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    words = docs.select(F.explode(F.split(_line(_lower("text")), " ")).alias("word")).where(F.col("word").isin(vocabulary))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _share(words: list[str]):
    return lambda b: F.size(F.array_intersect(b, _strings(words))) / len(words)


def scan(docs: DataFrame, counts: dict[str, int], templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs; counts order the templates' words."""
    needed = _needed(templates)
    order = {w: i for i, w in enumerate(sorted({w for _, words, _ in needed for w in words}, key=lambda w: (counts.get(w, 0), w)))}
    sets = [sorted(words, key=order.__getitem__) for _, words, _ in needed]
    needs = [need for _, _, need in needed]
    prefixes = [words[: len(words) - need + 1] for words, need in zip(sets, needs, strict=True)]
    rare = sorted({w for p in prefixes for w in p})
    any_rare = " (?:" + "|".join(rare) + ") "
    every = _strings(list(order))
    rows = docs.select(F.col("doc_id").cast("long"), _line(_lower(F.coalesce("text", F.lit("")))).alias("line"))
    rows = rows.withColumn("n_words", F.when(F.col("line") == "  ", 0).otherwise(_spaces(F.col("line")) - 1).cast("long"))
    # of each phrase that is there: what stands between its places
    rows = rows.withColumns({f"p{i}": F.when(F.contains("line", F.lit(f" {p} ")), F.split("line", f" {p}(?= )")) for i, p in enumerate(PHRASES.values())})
    # of each text that holds a rare word: its words, and of its blocks their template words, rarest first
    rows = rows.withColumn("words", F.when(F.col("line").rlike(any_rare), F.split(F.trim("line"), " "))).drop("line")
    # words stands twice here, so the plan keeps it apart and splits once, not for every block
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(REACH))
    blocks = F.transform(starts, lambda i: F.array_intersect(every, F.slice("words", i + 1, 2 * REACH)))
    rows = rows.withColumn("blocks", F.when(F.col("words").isNotNull(), F.filter(blocks, lambda b: F.size(b) > 0))).drop("words")

    def passes(words, prefix, need):
        def test(b: Column) -> Column:
            room = F.lit(False)
            for i, w in enumerate(prefix):
                j = F.array_position(b, w)
                room = room | ((j > 0) & (F.least(F.lit(len(words) - i), F.size(b) - j + 1) >= need))
            # where the rarest shared word is a later one of the prefix, none before it counts: any that has room lets the block pass
            return (F.size(b) >= need) & room

        return test

    best = {}
    for k, (words, prefix, need) in enumerate(zip(sets, prefixes, needs, strict=True)):
        most = F.array_max(F.transform(F.filter("blocks", passes(words, prefix, need)), _share(words)))
        best[f"b{k}"] = F.when(most >= need / len(words) - 1e-9, most)
    rows = rows.withColumns(best)
    n, first, last, base = F.lit(0), [], [], []
    for i, (label, p) in enumerate(PHRASES.items()):
        cut = F.col(f"p{i}")
        n = n + F.coalesce(F.size(cut) - 1, F.lit(0)) if i else F.coalesce(F.size(cut) - 1, F.lit(0))
        first.append(_spaces(cut[0]))
        last.append(F.col("n_words") - (_spaces(F.element_at(cut, -1)) - 1) - len(p.split()))
        base.append(F.when(cut.isNotNull(), label))
    added = [F.when(F.col(f"b{k}").isNotNull(), label) for k, (label, _, _) in enumerate(needed)]
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    found = [F.coalesce(f"b{k}", F.lit(0.0)) for k in range(len(sets))]
    return rows.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(base + added).alias("labels"),
        F.greatest(F.when(F.coalesce(*base).isNotNull(), 1.0).otherwise(0.0), *found).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, frequencies(docs))


def oracle() -> str:
    """SQL for op9_license_scan: the join without its filters."""
    phrases = ", ".join(f"('{label}', {[*p.split()]})" for label, p in PHRASES.items())
    templates = ", ".join(f"('{label}', {words}, {need})" for label, words, need in _needed(TEMPLATES))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '{_BETWEEN}'), lambda w: w <> '') AS words FROM d),
p(label, phrase) AS (VALUES {phrases}),
s AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
h AS (SELECT s.doc_id, p.label, i - 1 AS place FROM s JOIN p ON words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase),
b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id),
t(label, words, need) AS (VALUES {templates}),
l AS (SELECT doc_id, list_distinct(words[i + 1 : i + {2 * REACH}]) AS words FROM (SELECT doc_id, words, unnest(range(0, len(words), {REACH})) AS i FROM w) x),
m AS (SELECT doc_id, label, len(list_intersect(l.words, t.words)) / len(t.words) AS share FROM l, t WHERE len(list_intersect(l.words, t.words)) >= need),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
z AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(z.share, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN z USING (doc_id)
"""
