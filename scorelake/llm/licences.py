"""Licence scans by a positional rare-token index, in DataFrame functions only.

The templates' words are counted over all files. Each template is indexed by its `RARE` words of
highest inverse document frequency, with their positions. A file looks up those of its words that the
index holds; each posting says where the template would begin. Where at least two rare words agree on
one beginning, the template's key phrase must stand word by word at its place. The score of a match is
the share of the template's rare weight that agreed.

Base places are found beside that: each place where a base phrase's words stand in a row. They count
0.5 in the score of a file without a better match.

Words are runs of ASCII letters and digits and of any other characters from U+0080 on, lower-cased. (Lower-casing others
than A-Z as well changes no word's bounds and makes no ASCII letter of a base phrase.) A null text has no words.
Repeated rows are judged alike. Extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

RARE = 4
AGREE = 2
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: label, opening words of a well-known notice, phrase that must be there
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("reserved", "all rights reserved", "rights reserved"),
]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def build_index(words: DataFrame, templates: list = TEMPLATES, rare: int = RARE) -> dict:
    """Postings of each template's rarest words over all files of `words` (column `words`).

    The result is bounded by the templates: word -> [(template, position, idf)], and per template the
    total idf of its indexed words.
    """
    split = [t[1].split() for t in templates]
    vocabulary = sorted({w for t in split for w in t})
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = words.count()
    idf = {w: math.log((files + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary}
    postings: dict[str, list] = {}
    weight = []
    for number, sequence in enumerate(split):
        chosen = sorted(set(sequence), key=lambda w: (-idf[w], w))[:rare]
        places = [(i, w) for i, w in enumerate(sequence) if w in chosen]
        weight.append(sum(idf[w] for _, w in places))
        for i, w in places:
            postings.setdefault(w, []).append((number, i, idf[w]))
    return {"postings": postings, "weight": weight}


def _phrase_places(words: Column, phrase: str, label: str) -> Column:
    """Starts of a phrase as (start, label)."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        at = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            at = at & (F.get(words, i + j) == part)
        return F.coalesce(at, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


_PLACES = "array<struct<start:int,label:string>>"
_HITS = "array<struct<template:int,start:int,place:int,idf:double>>"


def base_places(words: Column) -> Column:
    """(start, label) of every base place; only files that hold a phrase's last word are walked."""
    none = F.array().cast(_PLACES)
    found = [F.when(F.array_contains(words, p.split()[-1]), _phrase_places(words, p, label).cast(_PLACES)).otherwise(none) for p, label in BASE.items()]
    return F.array_sort(F.concat(*found))


def rare_hits(words: Column, index: dict) -> Column:
    """(template, start, place, idf) for each indexed word of the file, in order."""
    names = F.array(*map(F.lit, index["postings"]))
    lists = F.create_map(
        *(x for w, entries in index["postings"].items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(v).alias("v")) for t, i, v in entries))))
    )
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    held = F.filter(numbered, lambda o: F.array_contains(names, o["word"]))
    posted = F.transform(
        held,
        lambda o: F.transform(
            F.element_at(lists, o["word"]),
            lambda p: F.struct(p["t"].alias("template"), (o["place"] - p["i"]).alias("start"), o["place"].alias("place"), p["v"].alias("idf")),
        ),
    )
    return F.when(F.arrays_overlap(words, names), F.array_sort(F.flatten(posted)).cast(_HITS)).otherwise(F.array().cast(_HITS))


def matches(words: Column, hits: Column, index: dict, templates: list = TEMPLATES, agree: int = AGREE) -> Column:
    """(label, score) of each template that at least `agree` rare words place alike and whose key phrase is there."""
    same = lambda a, b: (a["template"] == b["template"]) & (a["start"] == b["start"])
    # hits are sorted, so the agree-th hit of one beginning stands agree - 1 places after the first
    begun = F.filter(hits, lambda h, i: F.coalesce(same(h, F.get(hits, i + (agree - 1))), F.lit(False)) & ~F.coalesce(same(h, F.get(hits, i - 1)) & (i > 0), F.lit(False)))
    keys = []
    for label, sequence, phrase in templates:
        parts, key = sequence.split(), phrase.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        keys.append(F.struct(F.lit(label).alias("label"), F.lit(at).alias("at"), F.array(*map(F.lit, key)).alias("key")))
    table, weights = F.array(*keys), F.array(*map(F.lit, index["weight"]))

    def verified(h: Column) -> Column:
        t = F.get(table, h["template"])
        first = h["start"] + t["at"]
        return (first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, F.size(t["key"])) == t["key"])

    def scored(h: Column) -> Column:
        total = F.aggregate(F.filter(hits, lambda x: same(x, h)), F.lit(0.0), lambda s, x: s + x["idf"])
        return F.struct(F.get(table, h["template"])["label"].alias("label"), F.least(F.lit(1.0), total / F.get(weights, h["template"])).alias("score"))

    return F.transform(F.filter(begun, verified), scored)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: list = TEMPLATES, rare: int = RARE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = df.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))
    index = build_index(words, templates, rare)
    looked = words.select("doc_id", "words", base_places(F.col("words")).alias("places"), rare_hits(F.col("words"), index).alias("hits"))
    found = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), "places", matches(F.col("words"), F.col("hits"), index, templates).alias("found"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda m: m["label"]))))
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda m: m["score"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return found.select(
        F.col("doc_id").alias(key), "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"), F.try_element_at("places", F.lit(-1))["start"].cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"),
    )
