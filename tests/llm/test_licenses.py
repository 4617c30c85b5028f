import re

import pytest
from pyspark.sql import functions as F

from pitlog.llm import licenses as M
from pitlog.llm.license_rules import BASE, LEVELS, NAME, Rule, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. and again CC-BY 4.0, CC by",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}",
    "// SPDX-License-Identifier: Apache-2.0",
    "GPLv3 or LGPL 2.1 or later; GPL 2.0 or any later version, see the AGPL",
    "dual-licensed under MIT license and BSD 3-Clause License",
    "Creative Commons Attribution-ShareAlike 4.0 International; https://creativecommons.org/licenses/by-sa/4.0/",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "the émit license, permit licenses, summit license is nothing; mit license mit license MIT\tLICENSE",
    "gnu general public license " * 300,
    "all rights reserved. unlicense. public domain",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products",
    "apache", "cc", "gnu gnu general public", "", None, "  \n ", "İ MIT LİCENSE K mit license",
]


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def detect(words, known):
    """Every rule against the whole text, with Python's engine; (start, end, rule)."""
    norm = "".join(f" {w} " for w in words)
    out = []
    for r in known:
        for m in re.finditer(M.spaced(r.signature), norm):
            out.append((norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, r))
    return out


def resolved(found):
    """Finds that no other one dominates, by comparing all pairs."""
    def beats(a, b):
        inside = a[0] <= b[0] and a[1] >= b[1] and a[2].level >= b[2].level
        better = (a[1] - a[0], a[2].level, -a[2].place) > (b[1] - b[0], b[2].level, -b[2].place)
        return inside and better

    return [d for d in found if not any(beats(e, d) for e in found)]


def brute(text, known=None, base=BASE):
    words, known = words_of(text), rules() if known is None else known
    places = [(i, label) for phrase, label in base for i in range(len(words))
              if words[i : i + len(phrase.split())] == phrase.split()]
    kept = resolved(detect(words, known))
    labels = {r.label for _, _, r in kept} | {label for _, label in places}
    sure = max([r.confidence for _, _, r in kept], default=M.BASE_CONFIDENCE if places else 0.0)
    at = [i for i, _ in places]
    return (
        len(words), len(places), min(at, default=None), max(at, default=None),
        sorted({label for _, label in places}), sorted(labels), sure,
        sorted((a, b, r.label, r.level) for a, b, r in kept),
    )


def scanned(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.licenses for r in M.scan(docs, **kw).collect()}
    return [
        (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score,
         sorted((s.start, s.end, s.label, s.level) for s in x.spans))
        for x in (got[i] for i in range(len(texts)))
    ]


def test_scan_equals_all_rules_against_all_texts(spark):
    for text, got in zip(TEXTS, scanned(spark, TEXTS)):
        assert got == brute(text), text


def test_there_are_hundreds_of_ordered_rules():
    known = rules()
    assert len(known) > 300 and [r.place for r in known] == list(range(len(known)))
    assert len({r.signature for r in known}) > 300 and {r.level for r in known} == set(LEVELS.values())


@pytest.mark.parametrize(
    "text,labels",
    [
        (TEXTS[1], ["gpl", "gpl-3.0"]),
        (TEXTS[2], ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"]),
        (TEXTS[3], ["apache", "apache-2.0"]),
        (TEXTS[4], ["gpl-2.0-or-later"]),
        (TEXTS[0], ["mit"]),
    ],
)
def test_planted_notices(text, labels):
    assert brute(text)[5] == labels


def test_own_rules_overlaps_and_phrases_that_overlap_themselves(spark):
    own = [
        Rule(0, "long", "b", "a b c", NAME),
        Rule(1, "inner", "b", "b", NAME),
        Rule(2, "later", "c", "c d", NAME),
        Rule(3, "same", "b", "a b c", NAME),
    ]
    base = (("a a", "aa"), ("b", "b"))
    texts = ["a b c d", "a a a", "b b", "A-B c c D", "x " * 5000 + "b"]
    got = scanned(spark, texts, known=own, base=base)
    assert got == [brute(t, own, base) for t in texts]
    assert got[0][5] == ["b", "later", "long"] and got[1][:4] == (3, 2, 0, 1)
    assert scanned(spark, texts, known=[], base=base) == [brute(t, [], base) for t in texts]


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "mit license", "x"), (1, "mit license", "x")], "doc_id long, text string, norm string")
    out = M.scan(docs.withColumn("id", F.lit(5)).withColumn("licenses", F.lit("old")))
    assert out.columns == ["doc_id", "norm", "id", "licenses"] and out.count() == 2
    assert {(r.norm, r.id, tuple(r.licenses.labels)) for r in out.collect()} == {("x", 5, ("mit",))}
    assert M.scan(docs.limit(0)).count() == 0
