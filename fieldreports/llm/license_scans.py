"""License scans: an exact set-similarity join of text blocks with templates.

A template is a phrase of a licence notice; its tokens are the distinct words.  A
block of a text, for a template of n words, is ``n + n // SLACK`` consecutive words
that begin with a token of the template.  The join finds every block that holds at
least the share ``THRESHOLD`` of a template's tokens, ``need`` of them:

* tokens are ordered by the number of documents that hold them, rarest first; a
  block that has ``need`` of a template's tokens has one of its ``n - need + 1``
  rarest, its prefix.  Only words in some prefix are looked at further;
* length filter: the words around such a hit must hold ``need`` tokens that occur
  in templates at all;
* positional filter: the hit counts as the block's rarest token of the template,
  so ``need - 1`` tokens of higher rank must stand around it;
* what is left is verified: the tokens of each block that the hit can be in are
  counted.

Base phrases are templates with the whole phrase as threshold and no slack; an
exact check of the words' order follows.

Templates are a parameter, so the index over their prefixes is a literal in the
plan (a few hundred tokens at most) and the join runs inside the row: nothing is
shuffled but the counts of the templates' tokens.  A text costs time in
proportion to its words and its hits.  Only DataFrame operations are used.

Defined results: a null or empty text has no words, no places (0), no labels (an
empty text) and score 0; very long texts are handled whole, in one row; ties of
the token order go by the token, and do not change results; equal texts, and
repeated rows, have equal results; an empty table gives an empty table; other
columns are passed on by ``scan``, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words; upper-case letters are lowered where words are compared.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
SLACK = 4

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices whose labels the method adds.
NOTICES = (
    ("under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("under the apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("under cc by nc 4 0", "cc-by-nc-4.0"),
    ("under cc by sa 4 0", "cc-by-sa-4.0"),
    ("under cc by nd 4 0", "cc-by-nd-4.0"),
    ("under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
)


@dataclass(frozen=True)
class Template:
    """A phrase, its label, and the share of its tokens that a block must hold.
    ``exact``: the words must stand consecutively."""

    phrase: str
    label: str
    threshold: float = THRESHOLD
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.phrase)

    @property
    def need(self) -> int:
        tokens = len(set(self.words))
        return tokens if self.exact else max(1, -int(-self.threshold * tokens // 1))

    @property
    def width(self) -> int:
        return len(self.words) + (0 if self.exact else len(self.words) // SLACK)


TEMPLATES = tuple(Template(p, label, 1.0, True) for p, label in BASE) + tuple(Template(p, label) for p, label in NOTICES)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def _is_one_of(word: Column, tokens: list[str]) -> Column:
    """Is the word, with A-Z lowered, one of these (ASCII) tokens?  Other letters
    that lower to ASCII ones are told by their bytes."""
    return F.lower(word).isin(tokens) & (F.octet_length(word) == F.length(word))


def token_order(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    """The templates' tokens, by the number of documents that hold them, rarest first."""
    tokens = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.transform(F.filter(_words(F.col("text")), lambda w: _is_one_of(w, tokens)), F.lower))
    counted = docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()  # at most a row a token
    often = {r["token"]: r["count"] for r in counted}
    return sorted(tokens, key=lambda t: (often.get(t, 0), t))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _entry(template: Template, number: int, rank: dict[str, int]) -> Column:
    """The index entry of a template; tokens as ranks, rarest first."""
    tokens = sorted({rank[w] for w in template.words})
    return F.struct(
        F.lit(number).alias("template"),
        F.lit(tokens).alias("tokens"),
        F.lit(tokens[: len(tokens) - template.need + 1]).alias("prefix"),
        F.lit(template.need).alias("need"),
        F.lit(template.width).alias("width"),
        F.lit([rank[w] for w in template.words] if template.exact else []).cast("array<int>").alias("order"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, order: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``blocks``: an array of ``(template, start,
    shared)``, every block of the text that meets a template's threshold, by number
    of the template, its first word (from 0) and the number of shared tokens."""
    order = token_order(docs, templates) if order is None else order
    rank = {t: i + 1 for i, t in enumerate(order)}
    index = F.array(*[_entry(t, i, rank) for i, t in enumerate(templates)])
    prefixes = sorted({w for t in templates for w in t.words if rank[w] in sorted({rank[x] for x in t.words})[: len(set(t.words)) - t.need + 1]})
    reach = max(t.width for t in templates) - 1  # words of a block on either side of a hit
    words = F.col("_license_words")

    def ranks(some: Column) -> Column:
        return F.transform(some, lambda w: F.when(F.octet_length(w) == F.length(w), F.array_position(F.lit(order), F.lower(w)).cast("int")).otherwise(0))

    def blocks_of(hit: Column, first: Column, near: Column, t: Column) -> Column:
        """Blocks of a template that have the hit as their rarest token.  ``near``:
        ranks of the words from ``first`` on, the hit among them."""
        own = hit - first  # place of the hit in near
        rarest = near[own]
        low = F.greatest(own - t["width"] + 1, F.lit(0))
        around = F.array_distinct(F.filter(F.slice(near, low + 1, own + t["width"] - low), lambda r: r > 0))
        filters = (F.size(around) >= t["need"]) & (F.size(F.filter(around, lambda r: r > rarest)) >= t["need"] - 1)

        def block(s: Column) -> Column:
            shared = F.array_intersect(F.slice(near, s + 1, t["width"]), t["tokens"])
            whole = (F.size(t["order"]) == 0) | (F.slice(near, s + 1, t["width"]) == t["order"])
            good = F.array_contains(t["tokens"], near[s]) & (F.size(shared) >= t["need"]) & (F.array_min(shared) == rarest) & whole
            return F.when(good, F.struct(t["template"].alias("template"), (first + s).alias("start"), F.size(shared).alias("shared")))

        none = F.array().cast("array<struct<template:int,start:int,shared:int>>")
        return F.when(filters, F.array_compact(F.transform(F.sequence(low, own), block))).otherwise(none)

    def blocks_at(hit: Column) -> Column:
        first = F.greatest(hit - reach, F.lit(0))
        near = ranks(F.slice(words, first + 1, hit + reach + 1 - first))
        return _let(
            near,
            lambda n: F.flatten(F.transform(F.filter(index, lambda t: F.array_contains(t["prefix"], n[hit - first])), lambda t: blocks_of(hit, first, n, t))),
        )

    hits = F.array_compact(F.transform(words, lambda w, i: F.when(_is_one_of(w, prefixes), i)))
    split = docs.withColumn("_license_words", _words(F.col("text"))).withColumn("_license_hits", hits)
    blocks = F.array_sort(F.array_distinct(F.flatten(F.transform("_license_hits", blocks_at))))
    return split.withColumn("n_words", F.size(words).cast("long")).withColumn("blocks", blocks).drop("_license_words", "_license_hits")


def labelled(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``:
    places of the exact templates, labels of all, and the largest share of a
    template's tokens in a block (0 without one)."""
    found = scan(docs.select("doc_id", "text"), templates)
    exact = F.lit([t.exact for t in templates])
    names = F.lit([t.label for t in templates])
    sizes = F.lit([len(set(t.words)) for t in templates])
    base = F.filter("blocks", lambda b: exact[b["template"]])
    starts = F.transform(base, lambda b: b["start"].cast("long"))
    joined = lambda b: F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: names[x["template"]]))), ",")
    share = F.array_max(F.transform("blocks", lambda b: b["shared"] / sizes[b["template"]]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("blocks")).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )
