"""License scans by a positional index of rare license words.

License notices are templates: short sequences of words. Of each file, the license words with
the highest inverse document frequency are looked up in an index from words to places in
templates. Each lookup votes for a template at a relative position; votes that agree intersect,
and what remains is verified: the template's mandatory phrases must stand at their places in the
file. All of it are SQL functions. Files without a license word end after one set test.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..store import written

#: Rarest license words of a file that are looked up.
RARE = 8
#: Share of the looked-up words of a template that must agree on its position.
AGREE = 0.5
#: What parts words, once A-Z are lowered.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose places are always reported, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Template(NamedTuple):
    """A license notice as words; every phrase of ``must`` stands in ``text`` once."""

    label: str
    text: str
    must: tuple[str, ...]


# Public license notices.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        ("free software you can redistribute it", "published by the free software foundation"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "without fee is hereby granted")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template(
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike 4 0",),
    ),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("reserved", "copyright all rights reserved", ("all rights reserved",)),
    Template("reserved", "no part of this publication may be reproduced", ("publication may be reproduced",)),
)
# Words too common in any text to be looked up.
COMMON = frozenset(
    "a and any are at be by for in into is it no not of or that the this to under use used with without you may can".split()
)


class Index(NamedTuple):
    """Numbers of license words, their places in templates, and the phrases to verify."""

    words: list[str]
    #: For each word its places, as ``(template, position)``.
    postings: list[list[tuple[int, int]]]
    #: For each phrase: its words, the license word that finds it, and how far in that word stands.
    phrases: list[tuple[str, int, int]]
    #: For each template the phrases that must stand in it, as ``(phrase, position)``.
    musts: list[list[tuple[int, int]]]


def build_index(templates: Sequence[Template] = TEMPLATES) -> Index:
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for t, template in enumerate(templates):
        for at, word in enumerate(template.text.split()):
            if word not in COMMON:
                places[word].append((t, at))
    words = sorted(places)
    number = {w: i for i, w in enumerate(words)}
    phrases: dict[str, int] = {}
    listed: list[tuple[str, int, int]] = []
    musts = []
    for template in templates:
        whole, own = template.text.split(), []
        for phrase in template.must:
            parts = phrase.split()
            starts = [i for i in range(len(whole)) if whole[i : i + len(parts)] == parts]
            if len(starts) != 1:
                raise ValueError(f"{phrase!r} must stand once in {template.text!r}")
            if phrase not in phrases:
                # Found by its license word with the fewest places in templates.
                inside = min((len(places[w]), i) for i, w in enumerate(parts) if w in number)[1]
                phrases[phrase] = len(listed)
                listed.append((phrase, number[parts[inside]], inside))
            own.append((phrases[phrase], starts[0]))
        musts.append(own)
    return Index(words, [places[w] for w in words], listed, musts)


def normal(text: Column) -> Column:
    """The words of a text, A-Z lowered, one space before each; '' without words, NULL as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is fast. It differs from lowering A-Z in letters beyond ASCII, which stay beyond it
    # and inside their words, all but these two.
    odd = text.contains("\u0130") | text.contains("\u212a")
    plain = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return let(F.regexp_replace(plain, GAPS, " "), lambda t: F.rtrim(F.when(t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))))


def count_words(text: Column) -> Column:
    """Words of a normal text: each has one space before it."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(text: Column, phrase: str) -> Column:
    """``struct<n, first, last>``: how often a phrase stands in a normal text, and at which words; NULL if never."""
    words = len(phrase.split())

    def found(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        tail = count_words(F.element_at(pieces, -1)) + words
        return F.when(
            n > 0,
            F.struct(
                n.cast("long").alias("n"),
                count_words(F.get(pieces, F.lit(0))).alias("first"),
                (count_words(text) - tail).alias("last"),
            ),
        )

    return F.when(text.contains(f" {phrase}"), let(F.split(text, f" {phrase}(?= |$)", -1), found))


def _slots(words: Sequence[str]) -> tuple[int, list[int], list[str]]:
    """A table without collisions by the SQL hash: its size, and number and word in each slot."""

    def signed(word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    size = 2 * len(words) + 1
    while len({signed(w) % size for w in words}) < len(words):
        size += 1
    numbers, names = [-1] * size, [""] * size
    for i, w in enumerate(words):
        numbers[signed(w) % size], names[signed(w) % size] = i, w
    return size, numbers, names


def license_words(text: Column, index: Index) -> Column:
    """``struct<hits array<struct<word, at>>, phrases array<struct<phrase, at>>>`` of a normal text; NULL without a license word.

    ``phrases`` are places where a whole mandatory phrase stands: tried where its rarest word does.
    """
    size, numbers, names = _slots(index.words)
    number_of, name_of = F.lit(numbers), F.lit(names)

    def number(word: Column) -> Column:
        slot = F.pmod(F.xxhash64(word), F.lit(size)).cast("int")
        return let(slot, lambda s: F.when(F.get(name_of, s) == word, F.get(number_of, s)))

    tried = defaultdict(list)
    for p, (phrase, word, inside) in enumerate(index.phrases):
        tried[word].append((p, phrase, inside))

    def whole(words: Column) -> Column:
        hits = F.filter(
            F.transform(words, lambda w, i: F.struct(number(w).alias("word"), i.alias("at"))), lambda h: h["word"].isNotNull()
        )

        def phrases(h: Column) -> Column:
            def at(hit: Column) -> Column:
                options = [
                    F.when(
                        (hit["word"] == word)
                        & (hit["at"] >= inside)
                        & (F.array_join(F.slice(words, hit["at"] - inside + 1, F.lit(len(phrase.split()))), " ") == phrase),
                        F.struct(F.lit(p).alias("phrase"), (hit["at"] - inside).alias("at")),
                    )
                    for word, listed in tried.items()
                    for p, phrase, inside in listed
                ]
                return F.array_compact(F.array(*options))

            return F.flatten(F.transform(F.filter(h, lambda x: x["word"].isin(*tried)), at))

        return let(hits, lambda h: F.struct(h.alias("hits"), phrases(h).alias("phrases")))

    words = F.split(F.substr(text, F.lit(2)), " ", -1)
    return let(words, lambda w: F.when(F.arrays_overlap(w, F.lit(index.words)), whole(w)))


def document_frequencies(found: DataFrame, words: int) -> list[int]:
    """In how many rows each license word stands; one number for each word of the index."""
    per_word = (
        found.where("found is not null")
        .select(F.explode(F.array_distinct(F.transform("found.hits", lambda h: h["word"]))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    counted = dict(per_word.collect())  # at most one row per word of the index
    return [counted.get(i, 0) for i in range(words)]


def matches(found: Column, ranks: Sequence[int], index: Index, templates: Sequence[Template], rare: int, agree: float) -> Column:
    """``array<struct<label, score, at>>``: templates that the looked-up words agree on and their phrases verify.

    ``ranks`` orders the words of the index by inverse document frequency, the rarest 0. For each
    template the ``rare`` first of its words that the file has are looked up, so one long notice
    does not hide another.
    """
    hits, phrases = found["hits"], found["phrases"]
    none = F.array().cast("array<struct<label:string,score:double,at:int>>")

    def of_template(t: int, present: Column) -> Column:
        places: dict[int, list[int]] = defaultdict(list)
        for word, listed in enumerate(index.postings):
            for template, at in listed:
                if template == t:
                    places[word].append(at)
        own = sorted(places, key=ranks.__getitem__)
        places_of = F.lit([places[w] for w in own])

        def votes(chosen: Column) -> Column:
            """Each looked-up word at each relative position that its places allow."""

            def vote(h: Column) -> Column:
                listed = F.get(places_of, (F.array_position(F.lit(own), h["word"]) - 1).cast("int"))
                return F.transform(listed, lambda p: F.struct((h["at"] - p).alias("at"), h["word"].alias("word")))

            return F.flatten(F.transform(F.filter(hits, lambda h: F.array_contains(chosen, h["word"])), vote))

        def agreed(chosen: Column, cast: Column) -> Column:
            def one(at: Column) -> Column:
                same = F.size(F.array_distinct(F.transform(F.filter(cast, lambda v: v["at"] == at), lambda v: v["word"])))
                stands = F.lit(True)
                for phrase, inside in index.musts[t]:
                    stands = stands & F.array_contains(phrases, F.struct(F.lit(phrase).alias("phrase"), (at + inside).alias("at")))
                result = F.struct(
                    F.lit(templates[t].label).alias("label"), (same / F.lit(float(min(rare, len(own))))).alias("score"), at.alias("at")
                )
                return F.when((same >= F.ceil(F.lit(agree) * F.size(chosen))) & stands, result)

            return F.array_compact(F.transform(F.array_distinct(F.transform(cast, lambda v: v["at"])), one))

        looked_up = F.slice(F.filter(F.lit(own), lambda w: F.array_contains(present, w)), 1, rare)
        possible = F.lit(True)
        for phrase, _ in index.musts[t]:
            possible = possible & F.exists(phrases, lambda x: x["phrase"] == phrase)
        return F.when(possible, let(looked_up, lambda c: let(votes(c), lambda v: agreed(c, v)))).otherwise(none)

    def of_all(present: Column) -> Column:
        return F.concat(*(of_template(t, present) for t in range(len(templates))))

    return F.when(F.size(phrases) > 0, let(F.array_distinct(F.transform(hits, lambda h: h["word"])), of_all))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, rare: int = RARE, agree: float = AGREE
) -> DataFrame:
    """One row per row of ``docs``: base phrases, and the licenses whose templates are found.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found_at``.
    ``labels`` are those of base phrases and of verified templates, distinct and sorted; ``score`` is
    1 with a base phrase, else the greatest share of looked-up words that agree; ``found_at`` lists
    ``label:word`` of the templates. NULL and blank texts have no words; rows with NULL or
    repeated ids are rows of their own; an empty table gives no rows. Document frequencies cover
    all rows. Texts are read once and never shuffled.
    """
    index = build_index(templates)
    text = docs.select("doc_id", normal(F.col("text")).alias("text"))
    parts = [phrase_places(F.col("text"), phrase).alias(f"base{i}") for i, (phrase, _) in enumerate(BASE)]
    staged = text.select(
        "doc_id", count_words(F.col("text")).alias("n_words"), *parts, license_words(F.col("text"), index).alias("found")
    )
    found = written(staged, "license-words")
    frequency = document_frequencies(found, len(index.words))
    order = sorted(range(len(index.words)), key=lambda w: (frequency[w], index.words[w]))
    ranks = [0] * len(order)
    for rank, word in enumerate(order):
        ranks[word] = rank
    base = [F.col(f"base{i}") for i in range(len(BASE))]
    none = F.array().cast("array<string>")
    of_base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(base, BASE))))))
    by_method = matches(F.col("found"), ranks, index, templates, rare, agree)
    return (
        found.withColumn("method", by_method)
        .withColumn("of_base", of_base)
        .select(
            "doc_id",
            "n_words",
            sum((F.coalesce(b["n"], F.lit(0)) for b in base), F.lit(0)).cast("long").alias("n_base"),
            F.least(*(b["first"] for b in base)).alias("first_word"),
            F.greatest(*(b["last"] for b in base)).alias("last_word"),
            F.array_join("of_base", ",").alias("base_labels"),
            F.array_join(
                F.array_sort(F.array_union("of_base", F.coalesce(F.transform("method", lambda m: m["label"]), none))), ","
            ).alias("labels"),
            F.when(F.size("of_base") > 0, 1.0)
            .otherwise(F.coalesce(F.array_max(F.transform("method", lambda m: m["score"])), F.lit(0.0)))
            .alias("score"),
            F.array_join(
                F.coalesce(F.array_sort(F.array_distinct(F.transform("method", lambda m: F.concat_ws(":", m["label"], m["at"])))), none), ","
            ).alias("found_at"),
        )
    )
