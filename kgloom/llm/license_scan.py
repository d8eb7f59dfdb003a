"""License scans (native): an exact set-similarity join of text blocks with license templates.

A block is a run of words, over line ends, a quarter longer than the
template it is compared with, or what the text has left. It matches when it holds at least
nine tenths of the template's distinct words. Texts are read once: those whose whole
text can't match any template only leave counts. Words are ordered by their
document frequency over the whole corpus, rarest first; prefix, length and
positional filters then leave few block-template pairs to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, stage, strings, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
#: Passages of public license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = (9, 10)


def needed(n: int, threshold=THRESHOLD) -> int:
    """The least overlap that reaches the containment threshold."""
    return -(-threshold[0] * n // threshold[1])


def block_words(text: str) -> int:
    """How many words a block has that is compared with this template."""
    return -(-5 * len(text.split()) // 4)


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster, and the same where all characters are ASCII
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def rarity_order(hits: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by document frequency. hits: one column, an array of each document's. Bounded by the templates, whatever the corpus."""
    (name,) = hits.columns
    words = hits.select(F.explode(name).alias("word"))
    counted = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def _positions(words: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase in words, from 0."""
    k = len(phrase)

    def at(i):
        hit = words[i] == phrase[0]
        for j in range(1, k):
            hit = hit & (words[i + j] == phrase[j])
        return hit

    return F.when(F.arrays_overlap(words, strings(phrase[-1:])) & (F.size(words) >= k), F.filter(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<int>"))


def _matches(block: Column, order: list[str], templates, threshold) -> Column:
    """array<struct<label, containment>> of the templates that the block's words meet. block: in rarity order."""
    rank = {w: i for i, w in enumerate(order)}
    found = []
    for label, text in templates:
        own = sorted(set(text.split()), key=rank.get)
        least = needed(len(own), threshold)
        prefix = own[: len(own) - least + 1]
        own_c, prefix_c = strings(own), strings(prefix)
        head = F.slice(block, F.lit(1), F.size(block) - least + 1)
        first = F.array_intersect(prefix_c, head)[0]
        # what can still overlap from the first shared word on, on either side
        room = F.least(F.lit(len(own)) - F.array_position(own_c, first) + 1, F.size(block) - F.array_position(block, first) + 1)
        overlap = F.size(F.array_intersect(own_c, block))
        found.append(
            F.when((F.size(block) >= least) & F.arrays_overlap(head, prefix_c) & (room >= least) & (overlap >= least), F.struct(F.lit(label).alias("label"), (overlap / len(own)).alias("containment")))
        )
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _place(label: str):
    return lambda i: F.struct(F.lit(label).alias("label"), i.alias("start"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> DataFrame:
    """docs' columns but text, plus the struct `license`: n_words, places (label, start) of base phrases, and blocks (start, label, containment).

    Starts are words, from 0; of a template's blocks those that begin with one of its words are given.
    Null text counts as empty and gives empty lists. Rows are judged one
    by one, so repeated rows, null ids and further columns are kept as they
    are; a column `license` is replaced. An empty table stays empty. Nothing is shuffled but the templates' word counts.
    """
    plain = [c for c in docs.columns if c not in ("text", "license")]
    vocabulary = sorted({w for _, t in templates for w in t.split()})

    def may_match(hits: Column) -> Column:
        can = F.lit(False)
        for own in (sorted(set(t.split())) for _, t in templates):
            least = needed(len(own), threshold)
            can = can | ((F.size(hits) >= least) & (F.size(F.array_intersect(strings(own), hits)) >= least))
        return can

    def read(words: Column) -> Column:
        places = F.flatten(F.array(*[F.transform(_positions(words, p), _place(label)) for label, p in phrases]))
        # a block can't match a template that its whole text doesn't
        return let(F.array_intersect(strings(vocabulary), words), lambda hits: F.struct(
            F.size(words).cast("long").alias("n_words"), places.alias("places"), hits.alias("hits"), F.when(may_match(hits), words).alias("words")))

    seen = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("ls_row"), let(words_of(docs["text"]), read).alias("ls_read")), "license")
    order = rarity_order(seen.select("ls_read.hits"), vocabulary)
    order_c, words = strings(order), F.col("ls_read.words")

    def blocks_of(template) -> Column:
        label, text = template
        own = strings(sorted(set(text.split())))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(own, F.get(words, i)))

        def at(i: Column) -> Column:
            block = F.array_intersect(order_c, F.slice(words, i + 1, block_words(text)))
            return let(block, lambda b: F.transform(_matches(b, order, [template], threshold), lambda m: F.struct(i.alias("start"), m["label"].alias("label"), m["containment"].alias("containment"))))

        whole = F.size(F.array_intersect(own, F.col("ls_read.hits"))) >= needed(len(set(text.split())), threshold)
        return F.when(whole, F.flatten(F.transform(starts, at))).otherwise(F.array().cast(BLOCKS))

    blocks = F.when(words.isNotNull(), F.flatten(F.array(*[blocks_of(t) for t in templates]))).otherwise(F.array().cast(BLOCKS))
    return seen.select("ls_row.*", F.struct("ls_read.n_words", "ls_read.places", blocks.alias("blocks")).alias("license"))


BLOCKS = "array<struct<start:int,label:string,containment:double>>"


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, blocks = F.col("license.places"), F.col("license.blocks")
    starts = F.transform(places, lambda p: p["start"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.transform(places, lambda p: p["label"])
    return found.select(
        "doc_id", F.col("license.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(blocks, lambda b: b["label"]))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for label, phrase in PHRASES:
        hit = " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(phrase))
        places.append(f"[{{'label': '{label}', 'start': i}} FOR i IN range(len(words)) IF {hit}]")
    templates = ", ".join(f"({k}, '{label}', {block_words(text)}, {sorted(set(text.split()))!r})" for k, (label, text) in enumerate(TEMPLATES))
    enough = f"{THRESHOLD[1]} * len(list_intersect(own, {{}})) >= {THRESHOLD[0]} * len(own)"
    return f"""
WITH templates(template, label, width, own) AS (VALUES {templates}),
lowered AS (SELECT doc_id, {lower} AS text FROM documents),
worded AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS words FROM lowered),
based AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, {" || ".join(places)} AS places FROM worded
),
blocks AS (
  SELECT doc_id, label, own, words[i:i + width - 1] AS block FROM (
    SELECT *, unnest(range(1, len(words) + 1)) AS i FROM worded, templates WHERE {enough.format("words")}
  ) WHERE list_contains(own, words[i])
),
matched AS (
  SELECT doc_id, label, len(list_intersect(own, block)) / len(own) AS containment FROM blocks WHERE {enough.format("block")}
),
per_doc AS (SELECT doc_id, list(label) AS found, max(containment) AS containment FROM matched GROUP BY doc_id)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base,
  list_min([p.start FOR p IN places])::BIGINT AS first_word, list_max([p.start FOR p IN places])::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct([p.label FOR p IN places])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct([p.label FOR p IN places] || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM based LEFT JOIN per_doc USING (doc_id)"""
