"""The Jaccard join on groups of near copies, with small chunks and ranges, and its parts."""

import random
import re

import numpy as np
import pytest

from gridlens.llm import jaccard
from gridlens.llm.common import numbers, planes


def plain(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[root(i)] = root(j)
    names: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[root(i)] = min(names.get(root(i), doc), doc)
    return [(doc, len(sets[i]), names.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def corpus():
    """Groups of texts that differ by some words each, so that links form chains and stars; short
    texts; passages that unlike texts share; null and repeated ids."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts = []
    for size, length, edits in ((40, 120, 5), (25, 60, 2), (8, 300, 14), (30, 9, 1)):
        base = rng.choices(words, k=length)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = rng.choice(words)
            texts.append(" ".join(own))
    passage = rng.choices(words, k=60)
    texts += [" ".join(rng.choices(words, k=80) + passage) for _ in range(30)] + [" ".join(passage)]
    texts += ["one two three", "One two THREE", "one two three four five", None, "", " \n", texts[0], texts[0] + " "]
    texts += texts[5:9]
    return [(i if i % 13 else None if i % 2 else 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_all_pairs(spark, corpus, monkeypatch, small):
    if small:
        for name, value in (("CHUNK_BYTES", 2000), ("CHUNK_DOCS", 7), ("RANGES", 3), ("HEAVY_LEAST", 3), ("MEMBERS", 4), ("FILTER_BITS", 1 << 12)):
            monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in corpus], "doc_id bigint, text string, key string, n int, node int")
    found = jaccard.jaccard_components(docs.repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(corpus), key=str)


def test_one_of_each_keeps_one_row_of_a_component(spark, corpus):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(corpus)], "doc_id bigint, text string, __keep int")
    kept = jaccard.one_of_each(docs.repartition(5))
    assert kept.columns == docs.columns
    groups = plain(corpus)
    rows = [r["__keep"] for r in kept.collect()]
    blank = [i for i, g in enumerate(groups) if not g[1]]
    assert len(set(rows)) == len(rows) and set(blank) <= set(rows)
    named = {g[2] for g in groups if g[1]}
    assert {groups[i][2] for i in rows if groups[i][1]} == named


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 10, 200, 3000):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, n)) for _ in range(2))
        parity = jaccard._parity(x) ^ jaccard._parity(y)
        differ = sum(int(v & ((1 << 64) - 1)).bit_count() for v in parity.tolist())
        assert differ <= len(np.setxor1d(x, y))
        assert (jaccard._parity(x) == jaccard._parity(x[::-1])).all()


def test_texts_that_share_many_grams_make_a_pair_about_once(spark):
    """A family of sets that share most of a prefix, each in a component of its own but for some: every
    pair is found, and the join makes few rows more than pairs (one for each shared gram before)."""
    rng = random.Random(5)
    sets = {node: sorted(rng.sample(range(-20, 40), 45)) for node in range(1, 41)}
    sets |= {node: rng.sample(range(1000, 1200), 4) for node in range(41, 61)}
    label = {node: 1 if node < 6 else node for node in sets}
    rows = [(g, node, 100, i, label[node]) for node, own in sets.items() for i, g in enumerate(own)]
    entries = spark.createDataFrame(rows, "gram bigint, node bigint, n int, place int, label bigint")
    words = [0] * (jaccard.PARITIES // 64)
    known = spark.createDataFrame([(node, 100, words) for node in sets] * 2, "node bigint, n bigint, parity array<bigint>")
    found = [tuple(sorted(r)) for r in jaccard._pairs_in_buckets(entries, known).collect()]
    shared = {(x, y): len(set(sets[x]) & set(sets[y])) for x in sets for y in sets if x < y and label[x] != label[y]}
    assert set(found) == {pair for pair, n in shared.items() if n}
    assert len(found) < 1.1 * len(set(found)) < sum(shared.values()) / 20
    left = jaccard._remaining_pairs(entries, spark.createDataFrame([(9, 8)], "a bigint, b bigint"), known)
    assert {tuple(sorted(r)) for r in left.collect()} == set(found) - {(8, 9)}


def test_folded_parities_are_those_of_fewer_classes(spark):
    own = np.random.default_rng(3).integers(0, 1 << 63, 900, dtype=np.uint64)
    place = ((own >> np.uint64(24)) & np.uint64(jaccard.FOLDED - 1)).astype(np.int64)
    few = np.packbits((np.bincount(place, minlength=jaccard.FOLDED) & 1).astype(np.uint8)).view(np.int64)
    docs = spark.createDataFrame([(jaccard._parity(own).tolist(),)], "parity array<bigint>")
    assert docs.select(jaccard._folded(docs.parity)).first()[0] == few.tolist()


def test_lists_come_back_as_sent():
    values = np.array([0, 1, 255, 256, (1 << 40) - 1, 7], np.uint64)
    assert numbers(planes(values, 5), 5).tolist() == values.tolist()
    assert numbers(planes(values[:3], 2), 2).tolist() == [0, 1, 255]
    assert numbers(b"", 5).tolist() == []


def test_grams_that_occur_once_do_not_come_back():
    def sent(part, chunk, ids, docs):
        steps = np.diff(np.array(ids, np.uint64), prepend=np.uint64(0))
        return part, chunk, planes(steps, 5), planes(np.array(docs), 2), None

    back = jaccard._shared([sent(0, 4, [5, 9, 9, 30], [0, 0, 1, 2]), sent(0, 8, [5, 31], [3, 3])])
    read = {chunk: (np.cumsum(numbers(ids, 5)).tolist(), list(docs[-(len(ids) // 5):])) for _, chunk, ids, docs, _ in back}
    assert read == {4: ([5, 9, 9], [2, 2, 2]), 8: ([5], [2])}


@pytest.mark.parametrize("text", ["one", "one two three four five six", "a b c d e f g h", "", None])
def test_single_documents(spark, text):
    docs = spark.createDataFrame([(4, text)], "doc_id bigint, text string")
    assert [tuple(r) for r in jaccard.jaccard_components(docs).collect()] == plain([(4, text)])
