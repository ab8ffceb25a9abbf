"""The license scan against a plain version of its rules, on awkward and random texts."""

import random
import re

import pytest

from gridlens.llm import licenses

TEXTS = [
    "CC BY-SA 4.0 and GPL v2 or later",
    "This program is licensed under the GNU General Public License, version 3. MIT License; BSD 3-Clause License",
    "cc by cc by sa, General\nPublic  License v2; all RIGHTS\treserved all rights reserved",
    "https://creativecommons.org/licenses/by/4.0/ SPDX-License-Identifier: GPL-2.0-or-later; Apache License, Version 2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "accc by ccby cc bye ccé by general public licenses all rights reservedé",
    "ＣＣ BY İcc by K all\u0000rights\u0001reserved\u0002",
    "", " \n", None, "x", "word " * 3000 + "all rights reserved",
    "All rights reserved. " * 500, "copyright (c) 2001, 2002 2003 licensed under the foo license",
]


def plain(text):
    """Words, base places, base labels, labels and score, by scanning every rule everywhere."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    whole = " " + " ".join(words) + " "
    found = []
    for i, rule in enumerate(licenses.rules()):
        for m in re.finditer(licenses.bounded(rule.pattern), whole, re.ASCII):
            first = whole[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" ") + 1, i, rule))
    kept = []
    for a, b, i, rule in found:
        inside = any(
            c <= a and b <= d and other.priority <= rule.priority
            and (c, -d, other.priority, j) < (a, -b, rule.priority, i)
            for c, d, j, other in found
        )
        if not inside:
            kept.append(rule)
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    base = [(n, label) for p, label in phrases for n in range(len(words)) if words[n : n + len(p)] == p]
    starts, labels = [n for n, _ in base], {label for _, label in base}
    base_confidence = licenses.CONFIDENCE[licenses.NAME]
    score = max([licenses.CONFIDENCE[r.priority] for r in kept] + [base_confidence] * bool(base), default=0.0)
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for r in kept})), score,
    )


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    pool = [w for r in licenses.rules() for w in re.sub(r"[^a-z0-9 ]", " ", r.pattern).split()] + ["foo", "2", "0", "3"]
    phrases = [p for p, _ in licenses.BASE] + ["gnu general public license version 3", "apache license version 2 0", "mit license"]
    mixed = [" ".join(rng.choice([rng.choice(pool), rng.choice(phrases).title()]) for _ in range(30)) for _ in range(60)]
    texts = TEXTS + mixed
    return [(i if i % 5 else None, t) for i, t in enumerate(texts + texts[:8])]


def test_labels_equal_plain_rules(spark, corpus):
    rows = [(i, t, "r", 1, "w", 0) for i, t in corpus]
    schema = "doc_id bigint, text string, row string, rule int, words string, places int"
    found = licenses.license_labels(spark.createDataFrame(rows, schema).repartition(3)).collect()
    expected = [(i, *plain(t)) for i, t in corpus]
    key = str
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert licenses.license_labels(empty).count() == 0


def shortest(tree):
    """The shortest texts of a parsed pattern, one for each way through its alternatives."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name in ("IN", "NOT_LITERAL"):
            parts = ["?"]
        elif name == "SUBPATTERN":
            parts = shortest(arg[3])
        elif name == "BRANCH":
            parts = [t for branch in arg[1] for t in shortest(branch)]
        elif name == "MAX_REPEAT":
            parts = [t * arg[0] for t in shortest(arg[2])]
        else:
            parts = ["?"]
        out = sorted({x + y for x in out for y in parts})
    return out


def test_rules_are_hundreds_and_hold_their_keywords():
    """Every text that a rule matches holds the rule's keyword, so the gate loses nothing."""
    rules = licenses.rules()
    assert len(rules) > 200 and sum(r.base for r in rules) == len(licenses.BASE)
    for rule in rules:
        for text in shortest(re._parser.parse(rule.pattern.replace("[cs]", "s"))):
            assert rule.keyword in text, (rule, text)


def test_contained_places_go(spark):
    docs = spark.createDataFrame([(1, "GNU General Public License version 3")], "doc_id bigint, text string")
    places = licenses.detections(licenses.scan(docs)).collect()
    assert {(p.label, p.kept) for p in places} == {("gpl-3.0", True), ("gpl", False)}
