"""Positional matching of anchors against a plain version, and the order of documents of one id."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlens.llm import syncmers
from gridlens.llm.common import window_hashes


def plain_anchors(body):
    """(place, hash, size) of every closed syncmer, by definition."""
    if len(body) < syncmers.K:
        return [(0, xxhash.xxh3_64_intdigest(body), len(body))] if body else []
    data = np.frombuffer(body, np.uint8)
    inner, outer = window_hashes(data, syncmers.S).tolist(), window_hashes(data, syncmers.K).tolist()
    width = syncmers.K - syncmers.S + 1
    windows = [inner[i : i + width] for i in range(len(outer))]
    return [(i, outer[i], syncmers.K) for i, w in enumerate(windows) if min(w) in (w[0], w[-1])]


def covered(anchors):
    return len({p for a, _, size in anchors for p in range(a, a + size)})


def plain_likeness(x, y):
    """The longest rising chain by dynamic programming over all pairs of equal, equally numbered anchors."""
    a, b = plain_anchors(x), plain_anchors(y)
    if [h for _, h, _ in a] == [h for _, h, _ in b]:
        return 1.0
    if not a or not b:
        return 0.0

    def numbered(anchors):
        seen: dict = {}
        out = {}
        for anchor in anchors:
            seen[anchor[1]] = seen.get(anchor[1], -1) + 1
            out[anchor[1], seen[anchor[1]]] = anchor
        return out

    left, right = numbered(a), numbered(b)
    pairs = sorted((left[k], right[k]) for k in left.keys() & right.keys())
    length = [1] * len(pairs)
    for i, (_, q) in enumerate(pairs):
        length[i] += max((length[j] for j in range(i) if pairs[j][1][0] < q[0]), default=0)
    return max(length, default=0), covered(a) + covered(b), pairs


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeéñ ", k=rng.randint(2, 9))) for _ in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(25)]
    out += [out[0] + out[1], out[1] + out[0], out[2] * 3, out[2], "", "short", "x", out[3][:40] + "Z" + out[3][41:]]
    return out


def test_likeness_equals_plain_chain(texts):
    bodies = [t.encode() for t in texts]
    lists = syncmers.anchor_lists(bodies)
    seen = set()
    for i, x in enumerate(bodies):
        for j, y in enumerate(bodies):
            found, want = syncmers.likeness(lists[i], lists[j], (len(x), len(y))), plain_likeness(x, y)
            if isinstance(want, float):
                assert found == want
                continue
            longest, total, pairs = want
            # Chains of one length may cover different bytes; each is the length of some rising chain.
            assert 0 <= found <= 1 and (found > 0) == (longest > 0)
            if len(pairs) == longest:
                held = covered([p for p, _ in pairs]) + covered([q for _, q in pairs])
                assert found == pytest.approx(held / total)
                seen.add(round(found, 3))
    assert len(seen) > 5


def test_rising_chain_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(14))]
        chain = syncmers._rising(np.array(values, np.int64))
        picked = [values[i] for i in chain]
        best = [1] * len(values)
        for i in range(len(values)):
            best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        assert picked == sorted(set(picked)) and chain.tolist() == sorted(chain.tolist())
        assert len(picked) == max(best, default=0)


def test_edits_and_order_matter():
    rng = random.Random(7)
    halves = ["".join(rng.choices("abcdefgh ", k=2000)).encode() for _ in range(3)]
    base, swapped, edited = halves[0] + halves[1], halves[1] + halves[0], halves[0] + halves[2]
    lists = syncmers.anchor_lists([base, swapped, edited, base])

    def like(i, j):
        return syncmers.likeness(lists[i], lists[j], (4000, 4000))

    assert like(0, 3) == 1
    # The same anchors in another order: only one half can be matched by position.
    assert 0.4 < like(0, 1) < 0.6 and 0.4 < like(0, 2) < 0.6


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_next_documents_of_crowded_and_missing_ids(spark, partitions):
    rng = random.Random(3)
    rows = [(7 if i % 3 else None if i % 2 else i, "".join(rng.choices("abcdé ", k=rng.randint(0, 90)))) for i in range(120)]
    rows += [(5, None), (5, ""), (None, None)] + rows[:6] + [((1 << 63) - 1, "top")]
    docs = spark.createDataFrame([(*r, "p", True) for r in rows], "doc_id bigint, text string, part string, borrowed boolean")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = syncmers.compare_with_next(docs.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def order(row):
        key = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0] is None, -(row[0] or 0), key - (1 << 64) * (key >> 63), row[1] or ""

    ordered = [(doc, text or "") for doc, text in sorted(rows, key=order)]
    want = []
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half] if half else text
        bodies = [x.encode() for x in (text, changed, following)]
        lists = syncmers.anchor_lists(bodies)
        near = [syncmers.likeness(lists[0], lists[i], (len(bodies[0]), len(bodies[i]))) for i in (1, 2)]
        prints = [syncmers.fingerprint(lists[i][1]).tobytes().hex() for i in (0, 1)]
        want.append((doc, len(text), hashlib.sha256(bodies[1]).hexdigest(), *prints, *near))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(3, "alone in the table, with some words")], "doc_id bigint, text string")
    row = syncmers.compare_with_next(one).first()
    assert (row.doc_id, row.near_next) == (3, 1.0)
    assert syncmers.compare_with_next(one.filter(F.lit(False))).count() == 0
