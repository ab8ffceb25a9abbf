"""A bounded table from pieces of text to their token ids, for tokenizers that work piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np

# Entries a worker keeps, and the longest piece it keeps; both bound its memory (about 120 MB).
KEPT_PIECES = 400_000
KEPT_LENGTH = 48


class PieceTable:
    """Ids of pieces as little-endian 32-bit bytes; unknown pieces are encoded in batches.

    Pieces not seen since the table last filled up are forgotten. Only speed depends on what is
    kept: a piece always has the same ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT_PIECES) -> None:
        self.encode, self.kept, self.old = encode, kept // 2, {}
        self.ids = {"": b""}

    def lookup(self, rows: Iterable[list[str]]) -> list[bytes]:
        """Ids of each row's pieces, joined."""
        rows = list(rows)
        if len(self.ids) > self.kept:
            self.old, self.ids = self.ids, {"": b""}
        known, old = self.ids, self.old
        missing, long = [], []
        for x in set().union(*rows).difference(known):
            if x in old:
                known[x] = old[x]
            else:
                missing.append(x)
        if missing:
            known.update(zip(missing, self.encode(missing), strict=True))
            long = [x for x in missing if len(x) > KEPT_LENGTH]
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        for x in long:
            del known[x]
        return out


class PieceArena:
    """Ids of pieces in one array, with the place of each piece in a dictionary; the ids of whole
    batches are gathered at once.

    ``encode`` gives the ids of some pieces in a row and how many each has. Pieces not seen since the
    table last filled up are forgotten. Only speed depends on what is kept. ``END`` is the piece that
    ends a row; no other piece holds it.
    """

    END = "\n"

    def __init__(
        self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end_id: int, kept: int = KEPT_PIECES * 3 // 2
    ) -> None:
        self.encode, self.kept = encode, kept
        self.end = np.array([end_id], np.int32)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {self.END: 0}
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids, self.chars = self.end, 0
        self.used = np.ones(1, bool)

    def shrink(self) -> None:
        """Keep the pieces used since the last time, unless they are most of the table."""
        kept = np.flatnonzero(self.used)
        if len(kept) > self.kept // 2 or self.chars > self.kept * KEPT_LENGTH:
            self.forget()
            return
        names = list(self.place)
        self.place = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        lengths = self.lengths[kept]
        starts = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(self.starts[kept] - starts, lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.used = starts, lengths, np.zeros(len(kept), bool)
        self.used[0] = True
        self.chars = sum(map(len, self.place))

    def gather(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by the end id, and the offsets of the rows (n + 1)."""
        if len(self.place) > self.kept or self.chars > self.kept * KEPT_LENGTH:
            self.shrink()
        for row in rows:
            row.append(self.END)
        flat = list(chain.from_iterable(rows))
        codes = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(codes < 0)
        self.used[codes[codes >= 0]] = True
        if len(unknown):
            found = list(map(flat.__getitem__, unknown.tolist()))
            self._add(list(dict.fromkeys(found)))
            codes[unknown] = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        sizes = self.lengths[codes]
        before = np.append(0, np.cumsum(sizes))
        offsets = before[np.append(0, np.cumsum(list(map(len, rows)))).astype(np.int64)]
        return self.ids[np.repeat(self.starts[codes] - before[:-1], sizes) + np.arange(before[-1])], offsets

    def _add(self, pieces: list[str]) -> None:
        ids, lengths = self.encode(pieces)
        first = len(self.place)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), bool)])
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
