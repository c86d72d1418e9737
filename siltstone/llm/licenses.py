"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are short licence notices; their words that aren't stop words form the index vocabulary, with a posting
(template, position) for each occurrence. The inverse document frequency of a vocabulary word comes from all files. Of the
words in a template's mandatory key phrases the `rare` with the highest IDF are looked up, at all their places in all
files; postings that agree on the relative position of file and template vote together. An alignment counts if the key
phrases stand at their places and enough of the template's words match; so each alignment that counts has all its
template's votes, and none is lost, however many notices a file holds. Phrases of the base list are found at every place
they stand.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Licence notices (label, text, mandatory key phrases).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license as published"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike", ["creative commons attribution sharealike"]),
    ("cc-by", "Creative Commons Attribution", ["creative commons attribution"]),
    ("cc0", "Creative Commons Zero, CC0 1.0 Universal", ["cc0"]),
]
#: Words too common to be looked up.
STOP = frozenset("a an and any are as at be by for from in is it may not of on or provided that the this to under use with you".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _stands(words: Column, phrase: list[str], i: Column) -> Column:
    """Whether the phrase's words stand from the 0-based place i on."""
    found = F.lit(True)
    for k, w in enumerate(phrase):
        found = found & F.coalesce(F.get(words, (i + F.lit(k)).cast("int")) == w, F.lit(False))
    return found


def _places(phrase: list[str]) -> Column:
    """All places where the phrase stands in `words`."""
    return F.array_compact(F.transform("words", lambda w, i: F.when((w == phrase[0]) & _stands(F.col("words"), phrase, i), i)))


def _templates() -> list[tuple[str, list[str], list[tuple[int, list[str]]]]]:
    """Label, words, and (place, words) of the key phrases of each template."""
    out = []
    for label, text, keys in TEMPLATES:
        body = words_of(text)
        out.append((label, body, [(next(i for i in range(len(body)) if body[i : i + len(key)] == key), key) for key in map(str.split, keys)]))
    return out


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 4, votes: int = 2, coverage: float = 0.75) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters and digits after lower-casing A-Z, numbered from 0; a null text counts as empty. labels
    holds the base labels and those of aligned templates; score is the best alignment's share of matching words, 0.5 if
    only a base phrase stands, else 0. Of each template the `rare` key words with the highest IDF are looked up at all
    their places, and an alignment is verified if `votes` of them (all, if there are fewer) agree on it; as the key phrases
    must stand anyway, every alignment that counts has these votes, and `rare` changes no result. Null ids pass through,
    repeated rows come back each, texts are read whole, an empty table gives an empty result, other columns are ignored.

    The texts are cut into words once and stored; the word counts of the vocabulary are the only shuffle, and each file's
    alignments are found and verified in its own row.
    """
    templates = _templates()
    vocabulary = sorted({w for _, body, _ in templates for w in body} - STOP | {w for p in PHRASES for w in p.split() if w not in STOP})
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced.alias("line"))
    rows = rows.withColumn("words", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " ")))
    rows = rows.withColumn("known", F.array_intersect("words", _array(vocabulary)))
    rows = cut(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "known", F.when(F.size("known") > 0, F.col("words")).otherwise(F.array().cast("array<string>")).alias("words")), "licence-words")

    # at most one row per vocabulary word
    total = rows.count()
    df = {r["word"]: r["count"] for r in rows.select(F.explode("known").alias("word")).groupBy("word").count().collect()}
    postings: dict[str, list[tuple[int, int]]] = {}
    need = []
    for number, (_, body, keys) in enumerate(templates):
        places = sorted({i for start, key in keys for i in range(start, start + len(key)) if body[i] not in STOP}, key=lambda i: (-math.log((1 + total) / (1 + df.get(body[i], 0))), i))
        best = places[: max(rare, votes)]
        need.append(min(votes, len(best)))
        for i in best:
            postings.setdefault(body[i], []).append((number, i))
    posting = F.create_map(*[x for w, own in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("template"), F.lit(i).alias("place")) for t, i in own]))])

    # each hit votes for (template, shift); a file place votes for an alignment at most once, so equal votes are its words
    hit = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(list(postings)), F.transform(posting[w], lambda p: F.struct(p["template"].alias("template"), (i - p["place"]).alias("shift"))))))
    voted = rows.withColumn("sought", F.arrays_overlap("known", _array(list(postings)))).withColumn("votes", F.when(F.col("sought"), F.array_sort(F.flatten(hit))).otherwise(F.array().cast("array<struct<template:int,shift:int>>")))
    enough = lambda v, i: F.coalesce(F.get("votes", i - 1) != v, F.lit(True)) & (F.get("votes", i + F.get(_array(need), v["template"]) - 1) == v)
    aligned = voted.withColumn("aligned", F.filter("votes", enough))

    word = lambda i: F.get("words", i.cast("int"))
    kind = F.array(*[F.struct(F.lit(label).alias("label"), _array(body).alias("body"), F.array(*[F.struct(F.lit(at).alias("place"), _array(key).alias("phrase")) for at, key in keys]).alias("keys")) for label, body, keys in templates])

    def verdict(v: Column) -> Column:
        t = F.get(kind, v["template"])
        match = F.aggregate(F.transform(t["body"], lambda w, i: F.coalesce(word(v["shift"] + i) == w, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x) / F.size(t["body"])
        stands = F.forall(t["keys"], lambda k: F.forall(F.transform(k["phrase"], lambda w, i: F.coalesce(word(v["shift"] + k["place"] + i) == w, F.lit(False))), lambda ok: ok))
        return F.struct(t["label"].alias("label"), match.alias("share"), stands.alias("stands"))

    tried = aligned.withColumn("tried", F.filter(F.transform("aligned", verdict), lambda v: v["stands"] & (v["share"] >= coverage)))
    for k, phrase in enumerate(PHRASES):
        tried = tried.withColumn(f"p{k}", _places(phrase.split()))
    every = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("tried", lambda v: v["share"]))
    return tried.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("tried", lambda v: v["label"]))).alias("labels"), F.coalesce(best, F.when(F.size(every) > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )
