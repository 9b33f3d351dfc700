"""Ids of text pieces that were met before, looked up a slice of texts at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._text import Words


class _Known:
    """Sorted piece hashes, a run of the id store each. A piece is recognised by hash, length and its
    first and last eight bytes, which is all of most pieces."""

    FIELDS = ("key", "size", "head", "tail", "start", "count")

    def __init__(self):
        kinds = (np.uint64, np.int32, np.uint64, np.uint64, np.int64, np.int32)
        self.columns = {f: np.zeros(0, k) for f, k in zip(self.FIELDS, kinds, strict=True)}

    def __len__(self) -> int:
        return len(self.columns["key"])

    def find(self, asked: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, found) of pieces that are sorted by hash."""
        c = self.columns
        if not len(self):
            return np.zeros(len(asked["key"]), np.int64), np.zeros(len(asked["key"]), bool)
        at = np.minimum(np.searchsorted(c["key"], asked["key"]), len(self) - 1)
        found = c["key"][at] == asked["key"]
        for f in ("size", "head", "tail"):
            found &= c[f][at] == asked[f]
        return at, found

    def add(self, rows: dict[str, np.ndarray]) -> None:
        """Rows sorted by key join; of equal keys the one that is here stays."""
        at = np.searchsorted(self.columns["key"], rows["key"])
        if len(self):
            new = self.columns["key"][np.minimum(at, len(self) - 1)] != rows["key"]
            at, rows = at[new], {f: v[new] for f, v in rows.items()}
        self.columns = {f: np.insert(c, at, rows[f]) for f, c in self.columns.items()}


class PieceStore:
    """At most ``most`` pieces are kept, of at most ``LONGEST`` ids each and ``MEAN`` on average, which
    bounds the bytes; those that come first are kept, as frequent pieces come early."""

    YOUNG = 1 << 16
    LONGEST, MEAN = 32, 8

    def __init__(self, kind: str, most: int):
        self.kind, self.width, self.most = kind, np.dtype(kind).itemsize, most
        self.old, self.young = _Known(), _Known()
        self.ids, self.used = np.zeros(1 << 20, kind), 0

    def __len__(self) -> int:
        return len(self.old) + len(self.young)

    def _keep(self, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, counts) of new runs of ids."""
        count = np.array(list(map(len, made)), np.int32) // self.width
        total = int(count.sum())
        if self.used + total > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + total), self.kind)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(made), self.kind)
        start = self.used + np.cumsum(count) - count
        self.used += total
        return start.astype(np.int64), count

    def encode(self, words: Words, learn: Callable[[list[int]], list[bytes | None]], mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | np.ndarray | None:
        """(ids, ids per piece) of the pieces of a slice. ``learn`` gets the numbers of pieces that are not
        known, each kind once; ``mark`` tells equal bytes apart that encode differently.

        Where ``learn`` has None for a piece, the result is a mask of the pieces of that kind; where
        hashes of different pieces are equal, it is None."""
        head, tail = words.ends()
        size = (words.end - words.start).astype(np.int32)
        key = words.hashes()
        if mark is not None:
            key = np.where(mark, ~key, key)
            size = np.where(mark, -size, size)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        asked = {"key": unique, "size": size[first], "head": head[first], "tail": tail[first]}
        if any((asked[f][inverse] != v).any() for f, v in (("size", size), ("head", head), ("tail", tail))):
            return None
        start, count = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int32)
        open_ = np.ones(len(unique), bool)
        for known in (self.old, self.young):
            at, found = known.find(asked)
            found &= open_
            start[found], count[found] = known.columns["start"][at[found]], known.columns["count"][at[found]]
            open_ &= ~found
        before, new = self.used, np.flatnonzero(open_)
        if len(new):
            made = learn(first[new].tolist())
            if None in made:
                return np.isin(inverse, new[[x is None for x in made]])
            start[new], count[new] = self._keep(made)
        per_piece = count[inverse].astype(np.int64)
        ends = np.cumsum(per_piece)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(start[inverse] - ends + per_piece, per_piece)]
        if len(new):
            self._remember({f: v[new] for f, v in asked.items()} | {"start": start[new], "count": count[new]}, before)
        return ids, per_piece

    def _remember(self, rows: dict[str, np.ndarray], before: int) -> None:
        if len(self) >= self.most or before >= self.most * self.MEAN:
            self._let_go(before)
            return
        short = rows["count"] <= self.LONGEST
        if not short.all():  # the ids of the others are overwritten
            rows = {f: v[short] for f, v in rows.items()}
            ends = np.cumsum(rows["count"], dtype=np.int64)
            total = int(ends[-1]) if len(ends) else 0
            begins = ends - rows["count"]
            self.ids[before : before + total] = self.ids[np.arange(total) + np.repeat(rows["start"] - begins, rows["count"])]
            rows["start"] = before + begins
            self._let_go(before + total)
        self.young.add(rows)
        if len(self.young) > self.YOUNG:
            self.old.add(self.young.columns)
            self.young = _Known()

    def _let_go(self, used: int) -> None:
        self.used = used
        room = max(1 << 20, 2 * used)
        if len(self.ids) > 4 * room:  # a slice of long pieces had it grow
            self.ids = self.ids[:room].copy()


def per_text(words: Words, per_piece: np.ndarray) -> np.ndarray:
    """Sums of a piece column by text."""
    return np.diff(np.concatenate(([0], np.cumsum(per_piece)))[words.first])
