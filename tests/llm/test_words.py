"""The piece table that forgets: gathered ids never depend on what it holds."""

import random

import numpy as np

from gridlens.llm.words import PieceArena


def encode(pieces):
    ids = [[ord(c) for c in x] for x in pieces]
    return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)


def test_small_tables_give_the_same_ids():
    rng = random.Random(1)
    table = PieceArena(encode, 7, kept=50)
    sizes = set()
    for _ in range(400):
        rows = [
            ["".join(rng.choices("abcdefgh", k=rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randint(0, 9))]
            for _ in range(rng.randint(1, 6))
        ]
        want = [[ord(c) for x in row for c in x] + [7] for row in rows]
        ids, ends = table.gather(rows)
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == want
        sizes.add(len(table.place))
    assert max(sizes) < 120 and len(sizes) > 5
