"""Filter audit, ranked search and license scan against brute force."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetqa.llm import filter_audit, lexical_search, license_scan

from .test_exact import SCHEMA, docs, none, rows, words  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Filter audit


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("aAbB #$|\t\n\x0b\x1c éЖ日😀"), max_size=40), max_size=8),
    st.sampled_from([1, 2, 7, 64, 1 << 20]),
)
def test_byte_figures_against_plain_python(texts, window):
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    found = filter_audit.byte_figures(data, offsets, filter_audit.Powers(), window)
    for i, t in enumerate(texts):
        assert [int(found[name][i]) for name in filter_audit.FIGURES] == [
            len(words(t)), len(set(words(t))), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))
        ]


def test_spans_with_equal_hashes_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabdabc" + b"x" * 100 + b"x" * 99 + b"y", np.uint8)
    begin, length = np.array([0, 3, 6, 9, 109]), np.array([3, 3, 3, 100, 100])
    first = filter_audit.distinct_spans(data, begin, length, np.zeros(5, np.uint64), np.zeros(5, np.int64))
    assert first.sum() == 4 and first[[0, 2]].sum() == 1


def brute_audit(rows, labels):
    smallest = {}
    for doc_id, text, *_ in rows:
        key = (doc_id is None, doc_id or 0)
        smallest[text or ""] = min(smallest.get(text or "", key), key)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failing = []
    for doc_id, text, lang, *_ in rows:
        t, w = text or "", words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": (doc_id is None, doc_id or 0) > smallest[t],
        }
        failing.append((lang or "", {k for k, v in fails.items() if v}, doc_id))
    out = {}
    for part in {p for p, *_ in failing}:
        mine = [(f, d) for p, f, d in failing if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                lost = [(f, d) for f, d in left if x in f]
                earlier = [f for f, d in mine if f & set(order[: step - 1])]
                left = [(f, d) for f, d in left if x not in f]
                removed_by[x] += len(lost)
                out[part, "".join(order), step] = [
                    len(left), len(lost), sum(x in f for f in earlier), sum(f == {x} for f, _ in mine),
                    sum(d in good for _, d in lost), sum(d in toxic for _, d in lost),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark, docs, none, rows):  # noqa: F811
    given = [(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(-50, 300, 3)] + [(None, 1, 1), (6, None, 1), (6, 1, None)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels).collect()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in out} == brute_audit(rows, given)
    assert len(out) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(none, labels).count() == 0


def test_figures_keep_other_columns(docs, rows):  # noqa: F811
    out = filter_audit.text_figures(docs, window=1000).collect()
    assert Counter((r.doc_id, r.source, r.size, r.n_words, r.n_code_points) for r in out) == Counter(
        (r[0], r[3], r[5], len(words(r[1])), len(r[1] or "")) for r in rows
    )


# Ranked search


def brute_search(rows, items, ranks=10):
    found = [(r[0], Counter(TERM.findall(lowered(r[1])))) for r in rows]
    size = sum(bool(c) for _, c in found)
    length = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall(lowered(text)))
    out = {}
    for item, wanted in terms.items():
        scored = []
        for doc_id, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * size) // length
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        if scored:
            out[item] = [(-s, d) for s, _, _, d in sorted(scored, key=lambda x: x[:3])[:ranks]]
    return out


@pytest.mark.parametrize("block, owners", [(4096, 4), (7, 4), (3, 1), (1000, 2)])
def test_search_against_brute_force(spark, docs, rows, block, owners):  # noqa: F811
    items = [
        (1, "w1 W2 w3"), (2, "the and W59"), (3, None), (4, ""), (5, "absent"), (6, "École 日本 x y"), (7, "ONE"), (7, "two words"),
        (None, "w5"), (8, "w1 W2 w3"), (9, " ".join(f"w{i}" for i in range(60))),
    ]
    given = spark.createDataFrame(items, "item_id long, text string")
    out = defaultdict(list)
    for r in lexical_search.search(docs, given, owners=owners, block=block).orderBy("item_id", "rank").collect():
        out[r.item_id].append((r.score, r.doc_id))
        assert r.rank == len(out[r.item_id])
    assert dict(out) == brute_search(rows, items)


def test_search_with_many_groups_of_items(spark, docs, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    items = [(i, f"w{i} w{i + 1} the") for i in range(9)]
    out = defaultdict(list)
    for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("item_id", "rank").collect():
        out[r.item_id].append((r.score, r.doc_id))
    assert dict(out) == brute_search(rows, items)


def test_search_of_nothing(spark, docs, none):  # noqa: F811
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0


# License scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text, frequency, templates=license_scan.TEMPLATES):
    w = WORD.findall(lowered(text))

    def stands(phrase, at):
        parts = phrase.split()
        return at >= 0 and w[at : at + len(parts)] == parts

    base = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if stands(phrase, i)]
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for t in templates:
        whole = t.text.split()
        own = {x for x in whole if x not in license_scan.COMMON}
        present = sorted((x for x in own if x in w), key=lambda x: (frequency[x], x))[: license_scan.RARE]
        for at in range(-len(whole), len(w)):
            same = sum(
                any(whole[j] == x and 0 <= at + j < len(w) and w[at + j] == x for j in range(len(whole))) for x in present
            )
            if same and same >= license_scan.AGREE * len(present) and all(
                any(whole[j : j + len(p.split())] == p.split() and stands(p, at + j) for j in range(len(whole))) for p in t.must
            ):
                labels.add(t.label)
                score = max(score, same / min(license_scan.RARE, len(own)))
    starts = [i for i, _ in base]
    return (
        len(w), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9),
    )


LICENSED = [
    "Released under the MIT License.", "All rights reserved. ALL RIGHTS RESERVED, all rights", "cc by cc by CC-BY-NC 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "general public licensed", "gnu general public license version 2",
    "Licensed under the Apache License, Version 2.0. " + "filler " * 300 + "Released under the MIT License",
    "the license of mit", "apache license version 3 0", "mit licenſe", "GNU GENERAL PUBLIC LICENSE", "K all rights reserved İ",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    " (the Software), to deal in the Software without restriction. Redistribution and use in source and binary forms,"
    " with or without modification, are permitted provided that the following conditions are met:",
    "xall rights reserved", "all rights\nreserved", "éall rights reserved", "cc  by\tcc by", "licensed under cc by nc 4.0 under cc by sa 4 0",
]


def test_license_scan_against_brute_force(spark, docs, none, rows):  # noqa: F811
    texts = [*(r[1] for r in rows), *LICENSED, *(f"w1 {x} w2 " * 3 for x in LICENSED)]
    given = [(i, t, None, None, None, 0, 0, 0.0) for i, t in enumerate(texts)]
    index = license_scan.build_index()
    frequency = Counter(x for t in texts for x in set(WORD.findall(lowered(t))) & set(index.words))
    out = license_scan.scan(spark.createDataFrame(given, SCHEMA).repartition(3))
    found = {r.doc_id: (*r[1:7], round(r.score, 9)) for r in out.collect()}
    assert found == {i: brute_scan(t, frequency) for i, t in enumerate(texts)}
    assert license_scan.scan(docs).count() == len(rows)
    assert license_scan.scan(none).count() == 0


def test_license_scan_runs_no_python(docs):  # noqa: F811
    assert "Python" not in license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
