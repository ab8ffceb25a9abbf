"""Ranked search against a plain version, over many shards and blocks, and the use of pair bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridlens.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(docs, items, k=20):
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, c, sum(c.values())) for doc, c in held if c]
    n, length = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        query, scores = Counter(terms(text)), []
        for doc, c, size in held:
            m = 75 + 25 * size * n // length
            score = sum(q * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:k]):
            out.append((item, rank + 1, None if null else doc, -score))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéñ0", k=rng.randint(1, 6))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(400)]
    texts += texts[:40] + ["Ａ ＡB ab AB", None, "", " .,", "x" * 500, " ".join(words * 30), "Ab-ab_AB.ab"]
    docs = [(i if i % 11 else None if i % 2 else 7, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(3, items[4][1]), (None, "ab ab AB"), (50, None), (51, ""), (52, "unseen words only"), (53, words[0])]
    schema = "doc_id bigint, text string, n int, row string, shard int, score double"
    frame = spark.createDataFrame([(*d, 1, "r", 2, 0.5) for d in docs], schema).repartition(4)
    queries = spark.createDataFrame([(*i, 9, "q") for i in items], "item_id bigint, text string, item int, terms string")
    return frame, queries, docs, items


@pytest.mark.parametrize(("shard", "block"), [(ranking.SHARD_DOCS, ranking.BLOCK_TERMS), (9, 60)])
def test_ranks_equal_plain_version(corpus, monkeypatch, shard, block):
    frame, queries, docs, items = corpus
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranking, "FIRST_OF", 8)
    found = ranking.top_documents(frame, queries).collect()
    assert ordered(found) == ordered(plain(docs, items))


def test_few_results_wanted(corpus):
    frame, queries, docs, items = corpus
    assert ordered(ranking.top_documents(frame, queries, k=2).collect()) == ordered(plain(docs, items, 2))


def test_empty_tables(spark, corpus):
    frame, queries, _, _ = corpus
    assert ranking.top_documents(frame.limit(0), queries).count() == 0
    assert ranking.top_documents(frame, queries.limit(0)).count() == 0


def shard_of(lists, joint):
    """A shard from term -> {document: impact}."""
    held = sorted(lists)
    size = 1 + max(d for x in lists.values() for d in x)
    flat = [(d, lists[t][d]) for t in held for d in sorted(lists[t])]
    return ranking.Shard({
        "rows": np.arange(size), "terms": np.array(held), "starts": np.cumsum([0] + [len(lists[t]) for t in held]),
        "docs": np.array([d for d, _ in flat]), "impacts": np.array([i for _, i in flat]),
        "pairs": np.array([a * (1 << 32) + b for a, b in joint]), "joint": np.array(list(joint.values())),
    })


def test_pair_bounds_skip_more_than_single_bounds():
    """Two frequent terms whose best places differ: together they reach less than the sum of their
    greatest impacts, which lets the search stop adding documents earlier."""
    rng = random.Random(1)
    one = {d: rng.choice([1, 2]) if d % 2 else 60 for d in range(2000)}
    two = {d: rng.choice([1, 2]) if d % 2 == 0 else 60 for d in range(2000)}
    rare = {d: 100 for d in range(0, 2000, 50)}
    lists = {1: one, 2: two, 3: rare}
    joint = max(one[d] + two[d] for d in one)
    order = {1: (0, 0), 2: (0, 1), 3: (1, 0)}
    query = [(1, 1), (2, 1), (3, 1)]
    with_pair = shard_of(lists, {(1, 2): joint}).search(query, order, 0, 20)
    without = shard_of(lists, {}).search(query, order, 0, 20)
    best = sorted((-sum(x.get(d, 0) for x in lists.values()), d) for d in range(2000))[:20]
    for docs, scores, _ in (with_pair, without):
        assert sorted((-s, d) for d, s in zip(docs.tolist(), scores.tolist()))[:20] == best
    assert with_pair[2] < without[2] / 2


def test_bound_covers_repeated_terms():
    lists = {1: {0: 10, 1: 1}, 2: {0: 1, 1: 10}}
    shard = shard_of(lists, {(1, 2): 11})
    for x, y in ((1, 1), (3, 1), (1, 4)):
        reached = max(x * lists[1][d] + y * lists[2][d] for d in (0, 1))
        assert reached <= shard.bound([(1, x), (2, y)]) <= 10 * x + 10 * y
