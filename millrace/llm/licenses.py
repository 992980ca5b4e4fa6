"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block is a line of a document; its set is its distinct words. A block meets a template
if it holds at least `num / den` of the template's distinct words. Notices are often wrapped
over several lines, so the windows of a paragraph are blocks too: WINDOW times as many words as
the template has, in a row, across line ends. A paragraph ends at a line without words; one
whose lines hold a single word each is a list and has no windows. The join finds every such block:

* the words of all templates are ordered by how many documents hold them, rarest first
  (counted over the whole table, map-side; the list is as short as the templates);
* prefix filter: to hold k of m words, a block must hold one of the m - k + 1 rarest, so a
  document without any of these has no such block and isn't cut into blocks;
* length filter: a block of fewer than k distinct words can't;
* positional filter: if a block's first template word stands at place i (from 0), at most
  m - i words of the template are in it;
* survivors are verified by counting in their windows, so words that are strewn over a long line are
  no notice, and by name: a template with one of NAMES in it is only met where that word stands too;
* windows are only made in a document that holds k words of a template in all its lines together.

Blocks are filtered and verified where they are read: the templates are a small literal, so
nothing is shuffled but word counts, and a common line or a hot source costs no more than any
other. Fixed phrases are found beside that as places where their words stand consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as they stand in practice, and their labels. One label may have several.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
NUM, DEN = 8, 10
NAMES = ["mit", "apache", "bsd", "general", "public", "nc"]
"""Words that tell one license from another."""
WINDOW = 2
"""Words of a window for each word of a template."""
GAP = "\n[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\n"
TWO_WORDS = f"{WORD}[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+{WORD}"


def words_of(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return words_of(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))) for label, text in templates]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blocks_of(lower: Column, vocabulary: list[str]) -> Column:
    """For every line of a lower-cased text that holds a template word: its template words, how many distinct words it has, and the line."""
    own = F.transform(F.split(lower, "\n"), lambda line: F.struct(line.alias("line"), F.array_distinct(words_of(line)).alias("w")))
    known = F.transform(own, lambda b: F.struct(F.array_intersect(_texts(vocabulary), b["w"]).alias("held"), F.size(b["w"]).alias("size"), b["line"].alias("line")))
    return F.filter(known, lambda b: F.size(b["held"]) > 0)


def paragraphs_of(lower: Column) -> Column:
    """The words of each paragraph of several lines, if a line of it holds two words."""
    wrapped = F.filter(F.split(lower, GAP), lambda p: F.contains(p, F.lit("\n")) & F.rlike(p, F.lit(TWO_WORDS)))
    return F.transform(wrapped, words_of)


def _with(sets: Column, name: str) -> Column:
    return F.filter(sets, lambda s: F.array_contains(s, name))


def most_in_window(w: Column, ws: list[str], span: int) -> Column:
    """The most distinct words of `ws` that `span` words in a row hold, among them all names of `ws`."""
    starts = F.array_compact(F.transform(w, lambda x, i: F.when(F.array_contains(_texts(ws), x), i + 1)))
    held = F.transform(starts, lambda i: F.array_intersect(_texts(ws), F.slice(w, i, span)))
    for name in NAMES:
        if name in ws:
            held = _with(held, name)
    return F.coalesce(F.array_max(F.transform(held, F.size)), F.lit(0))


def word_order(df: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The template words by how many documents of the whole table hold them, rarest first."""
    held = df.select(F.explode(F.array_intersect(_texts(vocabulary), words(F.col(text)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(m: int, num: int = NUM, den: int = DEN) -> int:
    return max(1, -(-num * m // den))


def scan(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None, num: int = NUM, den: int = DEN,
) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    `n_base` counts all places of all phrases, `first_word` and `last_word` are the smallest and
    largest start (null without one). `labels` adds those of met templates; both lists are
    distinct, sorted and comma-joined, '' if empty. `score` is the largest share of a met
    template's words in one window of a block, 1 where a phrase stands, else 0. A null or empty text has no
    words. Repeated rows are scanned each; other columns aren't read.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    sets = template_words(templates)
    spans = [WINDOW * len(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    order = {w: i for i, w in enumerate(word_order(df, vocabulary, text))}
    ranked = sorted(vocabulary, key=order.__getitem__)

    ranked_sets = [(label, sorted(ws, key=order.__getitem__), needed(len(ws), num, den)) for label, ws in sets]
    prefixes = sorted({w for _, ws, k in ranked_sets for w in ws[: len(ws) - k + 1]})

    none_met = F.array().cast("array<struct<label:string,share:double>>")

    def only_met(shares: list[Column]) -> Column:
        met = F.filter(F.array(*shares), lambda x: x["met"])
        return F.transform(met, lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share")))

    def met_by(block: Column) -> Column:
        """(label, share) of each template that the block meets."""
        out = []
        for (label, ws, k), span in zip(ranked_sets, spans, strict=True):
            m, common = len(ws), F.array_intersect(_texts(ws), block["held"])
            first = F.array_position(_texts(ws), F.element_at(common, 1)).cast("int")
            near = (block["size"] >= k) & F.arrays_overlap(block["held"], _texts(ws[: m - k + 1]))
            most = F.when(near & (m - first + 1 >= k) & (F.size(common) >= k), most_in_window(words_of(block["line"]), ws, span)).otherwise(0)
            out.append(F.struct(F.lit(label).alias("label"), (most / F.lit(m)).alias("share"), (most >= k).alias("met")))
        return only_met(out) if out else none_met

    def enough(w: Column, ws: list[str], k: int) -> Column:
        return F.size(F.array_intersect(_texts(ws), w)) >= k

    def met_in(w: Column) -> Column:
        """(label, share) of each template that a window of these words meets."""
        out = []
        for (label, ws, k), span in zip(ranked_sets, spans, strict=True):
            most = F.when(enough(w, ws, k), most_in_window(w, ws, span)).otherwise(0)
            out.append(F.struct(F.lit(label).alias("label"), (most / F.lit(len(ws))).alias("share"), (most >= k).alias("met")))
        return only_met(out)

    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    last_words = sorted({p.split()[-1] for p in phrases})
    marked = docs.select("doc_id", lower.alias("lower"))
    suspect = F.lit(False)
    for w in last_words:
        suspect = suspect | F.contains("lower", F.lit(w))
    rows = marked.select("doc_id", "lower", suspect.alias("suspect"), words_of(F.col("lower")).alias("w"))

    def places_of(phrase: str, label: str) -> Column:
        def place(_, i: Column) -> Column:
            here = F.lit(True)
            for j, part in enumerate(phrase.split()):
                here = here & (F.get("w", i + j) == part)
            return F.when(here, F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

        return F.array_compact(F.transform("w", place))

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    found = F.coalesce(F.when(F.col("suspect"), F.concat(none, *(places_of(p, label) for p, label in phrases.items()))), none)
    near = F.arrays_overlap("w", _texts(prefixes))
    blocks = F.filter(blocks_of(F.col("lower"), ranked), lambda b: F.arrays_overlap(b["held"], _texts(prefixes)))
    likely = F.lit(False)
    for _, ws, k in ranked_sets:
        likely = likely | enough(F.col("w"), ws, k)
    wrapped = F.when(near & likely, F.flatten(F.transform(paragraphs_of(F.col("lower")), met_in)))
    met = F.concat(F.coalesce(F.when(near, F.flatten(F.transform(blocks, met_by))), none_met), F.coalesce(wrapped, none_met)) if sets else none_met
    based = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"), met.alias("met"))
    labels_of = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"])))
    starts = F.transform("found", lambda x: x["at"])
    return based.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels_of("found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels_of("found"), labels_of("met"))), ",").alias("labels"),
        F.greatest(F.when(F.size("found") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("met", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
