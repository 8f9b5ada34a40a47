"""License scan by an exact set-similarity join, in DataFrame functions only.

Text blocks (lines) and license templates are sets of words.  A template is found in a
block if the block holds at least the threshold's share of the template's words.  Words
are ordered by how many blocks of the whole corpus hold them, rarest first.  A block
that contains enough of a template must share one of the template's first words in
that order (prefix filter), hold enough words (length filter), and have enough words
left after the first common one (positional filter); the pairs left are verified.

Only words of some template can be common to a block and a template, so blocks are
reduced to those before anything is counted, ordered or joined.

A notice that is wrapped over lines is no block.  With wrapped=True a template is also
found where a run of words, across line breaks and at most SPAN times as many as the
template has, holds enough of its words.  A run slides over the template's words of a
text in one pass; only texts that hold enough of the words at all are passed over.

Notices of sister licenses share most of their words.  Such a template names the word that
tells it (lesser, affero, nc), which a block must hold, or those of its sisters, which a
block may not hold and at which a run ends, so each notice gets its own label alone.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import attached, read_table, stored, text_key, whole_text

THRESHOLD = 0.9
#: A wrapped notice stands in a run of at most so many times the template's words.
SPAN = 2

# The base phrases with their labels, and word and gap as patterns.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

class Template(NamedTuple):
    """A notice's label and text.

    must: words that a block has to hold besides enough of the others; bars: words of a
    sister license, with which a block is none of this template and at which a run ends.
    """

    label: str
    text: str
    must: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()


_SISTERS = ("affero", "lesser", "library")
#: Public license notices.
TEMPLATES = (
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", (), _SISTERS),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", (), _SISTERS),
    Template("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser",)),
    Template("lgpl", "it under the terms of the GNU Library General Public License as published by the Free Software Foundation", ("library",)),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero",)),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("cc-by", "Licensed under CC BY 4.0", (), ("nc", "nd", "sa")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("nc",), ("nd", "sa")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("sa",), ("nc",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("sharealike",), ("noncommercial",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def vocabulary_of(templates) -> list[str]:
    """All words that blocks are looked through for."""
    return sorted({w for t in map(lambda x: Template(*x), templates) for w in (*template_words(t.text), *t.must, *t.bars)})


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    return sorted(set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())))


def template_length(text: str) -> int:
    """All words of a template, repeated ones too."""
    return len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()))


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("bigint")


def _places() -> Column:
    """For each phrase that occurs in the folded text: its label, number of places, first and last start, counted in words.

    Only texts that hold the letters of all words of a phrase are searched for it.
    """
    none = F.lit(None).cast("struct<label:string,n:bigint,first:bigint,last:bigint>")
    found = []
    for phrase, label in PHRASES:
        words = phrase.split()
        pattern = f"{words[0]}(?<!{_WORD}{words[0]})" + "".join(f"{_GAP}+{w}" for w in words[1:]) + f"(?!{_WORD})"
        gaps = F.split("text", pattern, -1)  # what stands around the places
        last = F.col("n_words") - _count(F.element_at(gaps, -1)) - len(words)
        place = F.struct(F.lit(label).alias("label"), (F.size(gaps) - 1).cast("bigint").alias("n"), _count(gaps[0]).alias("first"), last.alias("last"))
        held = reduce(lambda a, b: a & b, [F.contains("text", F.lit(w)) for w in words])
        found.append(F.when(held & F.rlike("text", F.lit(pattern)), place).otherwise(none))
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def _runs(vocabulary: list[str], templates, threshold: float) -> Column:
    """label and containment of the templates that a run of words across the lines holds; from lines and blocks."""
    kinds = "array<struct<label:string,words:array<string>,must:array<string>,bars:array<string>,span:int,least:int>>"
    listed = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    known = []
    for t in map(lambda x: Template(*x), templates):
        words = template_words(t.text)
        known.append(F.struct(F.lit(t.label), listed(words), listed(t.must), listed(t.bars), F.lit(SPAN * template_length(t.text)), F.lit(math.ceil(threshold * len(words) - 1e-9))))
    held = F.array_distinct(F.flatten("blocks"))
    asked = F.filter(F.array(*known).cast(kinds), lambda t: (F.size(F.array_intersect(t["words"], held)) >= t["least"]) & (F.size(F.array_except(t["must"], held)) == 0))
    at = F.filter(F.transform(F.flatten("lines"), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    none = F.array().cast("array<struct<at:int,word:string>>")

    def most(t: Column, places: Column) -> Column:
        """The most different words of the template in a run that holds its musts: the last place of each is kept while it is near and no barred word follows."""

        def step(state: Column, x: Column) -> Column:
            near = F.concat(F.filter(state["near"], lambda y: (y["at"] > x["at"] - t["span"]) & (y["word"] != x["word"])), F.array(x))
            near = F.when(F.array_contains(t["bars"], x["word"]), none).otherwise(near)
            whole = F.size(F.array_except(t["must"], F.transform(near, lambda y: y["word"]))) == 0
            return F.struct(near.alias("near"), F.when(whole, F.greatest(state["most"], F.size(near))).otherwise(state["most"]).alias("most"))

        mine = F.filter(places, lambda x: F.array_contains(t["words"], x["word"]) | F.array_contains(t["bars"], x["word"]))
        return F.aggregate(mine, F.struct(none.alias("near"), F.lit(0).alias("most")), step, lambda state: state["most"])

    best = lambda places: F.transform(asked, lambda t: F.struct(t["label"].alias("label"), t["least"].alias("least"), F.size(t["words"]).alias("size"), most(t, places).alias("most")))
    met = F.filter(F.flatten(F.transform(F.array(at), best)), lambda m: m["most"] >= m["least"])  # the places are made once a text
    found = F.transform(met, lambda m: F.struct(m["label"].alias("label"), (m["most"] / m["size"]).alias("containment")))
    return F.when((F.size("blocks") > 1) & (F.size(asked) > 0), found).otherwise(F.array().cast("array<struct<label:string,containment:double>>"))


def prepared(docs: DataFrame, vocabulary: list[str], runs: Column | None = None) -> DataFrame:
    """doc_id, text_key, n_words, the base phrases' places, and each block's distinct vocabulary words; runs is added as a column."""
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.filter(F.split(line, _GAP + "+", -1), lambda w: w != ""))
    rows = docs.select("doc_id", text_key().alias("text_key"), F.translate(whole_text(), UPPER, UPPER.lower()).alias("text")).withColumn("lines", lines)
    n_words = F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, line: n + F.size(line))
    blocks = F.filter(F.transform("lines", lambda line: F.array_distinct(F.filter(line, lambda w: w.isin(vocabulary)))), lambda b: F.size(b) > 0)  # one look-up a word
    more = [] if runs is None else ["runs"]
    rows = rows.select("doc_id", "text_key", "text", n_words.alias("n_words"), blocks.alias("blocks"), *(["lines"] if more else []))
    rows = rows if runs is None else rows.withColumn("runs", runs)
    return rows.select("doc_id", "text_key", "n_words", _places().alias("places"), "blocks", *more)


def word_order(blocks: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of blocks that hold each word, rarest first."""
    counts = blocks.select(F.explode("block").alias("word")).groupBy("word").count().collect()  # at most one row for each vocabulary word
    known = {r.word: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (known.get(w, 0), w))


def found_templates(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(text_key, labels, containment) of the texts with a block that holds a template; rows from prepared()."""
    spark = rows.sparkSession
    templates = [Template(*x) for x in templates]
    vocabulary = vocabulary_of(templates)
    blocks = rows.select("text_key", F.explode("blocks").alias("block"))
    order = word_order(blocks, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    index, sizes = [], []
    for i, t in enumerate(templates):
        words = sorted(template_words(t.text), key=rank.get)
        least = math.ceil(threshold * len(words) - 1e-9)
        sizes.append(least)
        index += [(w, i, t.label, place, len(words), least, words, list(t.must), list(t.bars)) for place, w in enumerate(words[: len(words) - least + 1])]
    prefix = spark.createDataFrame(index, "word string, template int, label string, place int, size int, least int, words array<string>, must array<string>, bars array<string>")  # bounded by the templates
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("block"))
    shortest = min(sizes)
    kept = blocks.filter(F.size("block") >= shortest).select("text_key", ordered.alias("block"))
    kept = kept.select("text_key", "block", F.size("block").alias("held"), F.posexplode("block").alias("at", "word")).filter(F.col("at") <= F.col("held") - shortest)
    left = F.least(F.col("size") - F.col("place"), F.col("held") - F.col("at"))
    pairs = kept.join(F.broadcast(prefix), "word").filter((F.col("held") >= F.col("least")) & (left >= F.col("least")))
    common = F.size(F.array_intersect("words", "block"))
    met = pairs.withColumn("common", common).filter("common >= least AND size(array_except(must, block)) = 0 AND size(array_intersect(bars, block)) = 0")
    return met.groupBy("text_key").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max(F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, places, labels (arrays) and score.

    labels: the base phrases' and the found templates' labels, distinct and sorted;
    score: the greatest containment, 1 where a base phrase stands, else 0.  wrapped: also
    find templates in runs of words across lines.  A null text is empty.  Equal texts have
    equal results; other columns are ignored.
    """
    vocabulary = vocabulary_of(templates)
    rows = stored(prepared(docs, vocabulary, _runs(vocabulary, templates, threshold) if wrapped else None), "blocks")
    found = stored(found_templates(rows, templates, threshold), "found")
    runs = [F.col("runs")] if wrapped else []
    out = attached(rows.select("doc_id", "text_key", "n_words", "places", *runs), found, "text_key", "doc_id")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    labels, containment = F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("containment", F.lit(0.0))
    if wrapped:
        labels, containment = F.array_union(labels, F.col("runs.label")), F.greatest(containment, F.array_max("runs.containment"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(containment)
    return out.select("doc_id", "n_words", "places", base.alias("base_labels"), F.array_sort(F.array_union(base, labels)).alias("labels"), score.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), wrapped=True)
    of = lambda name: F.transform("places", lambda p: p[name])
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(of("n"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_base"),
        F.array_min(of("first")).alias("first_word"),
        F.array_max(of("last")).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _oracle() -> str:
    """The same by comparing each block with each template, and by looking at each word's successors."""
    listed = lambda words: f"{list(words)!r}::VARCHAR[]"
    templates = ", ".join(f"({i}, '{t.label}', {listed(template_words(t.text))}, {listed(t.must)}, {listed(t.bars)})" for i, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    fold = f"translate(t, '{UPPER}', '{UPPER.lower()}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all({fold}, '{word}') AS w FROM d),
x AS (SELECT r, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS x FROM w),
y AS (SELECT r, k, list(x) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM x),
f(p, label, n) AS (VALUES {phrases}),
h AS (SELECT r, k, label FROM y, f WHERE len(l) >= n AND array_to_string(l[1:n], ' ') = p),
b AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY r),
t(i, label, s, must, bars) AS (VALUES {templates}),
l AS (SELECT r, list_distinct(regexp_extract_all({fold.replace('(t,', '(line,')}, '{word}')) AS s FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT r, t.label, len(list_intersect(l.s, t.s)) / len(t.s) AS c FROM l, t WHERE len(list_intersect(l.s, t.s)) >= {THRESHOLD} * len(t.s) - 1e-9 AND list_has_all(l.s, must) AND NOT list_has_any(l.s, bars)),
u AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM m UNION ALL SELECT r, label FROM h) GROUP BY r),
c AS (SELECT r, max(c) AS c FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN u USING (r) LEFT JOIN c USING (r)
"""


ORACLE_SQL = _oracle()
