"""Byte-pair merges of many short words at once, and the tables that they need."""

from __future__ import annotations

import re

import numpy as np

NONE = np.int64(1) << 40  # rank of a pair that is not merged

# Latin-1 by the properties that the public patterns name.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
BLANKS = "\t-\r \x85\xa0"
LATIN = re.compile("[\0-ÿ]*")


class Pairs:
    """Pairs of ids with the rank and the result of their merge; lowest rank first, leftmost first among equals."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], made: list[int]):
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_at = keys[order], np.array(rank, np.int64)[order]
        self.made = np.zeros(max(rank, default=0) + 1, np.int64)
        self.made[rank] = made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_at[at], NONE)

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges within groups of symbols of these sizes (positive): the ids left, and how many each group has.

        Each round makes one merge in every group that has one, so the order within a group is that of a heap.
        """
        ids, group = ids.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        out, owner = [], []
        rank = np.full(len(ids), NONE)
        rank[:-1] = np.where(group[1:] == group[:-1], self.ranks(ids[:-1], ids[1:]), NONE)
        while len(ids):
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(ids)))
            ready = best == NONE
            out.append(ids[ready])
            owner.append(group[ready])
            at = np.flatnonzero((rank == best) & ~ready)
            at = at[np.append(True, group[at[1:]] != group[at[:-1]])] if len(at) else at  # leftmost of each group
            ids[at] = self.made[rank[at]]
            keep = ~ready
            keep[at + 1] = False
            rank[at] = NONE
            on = at[at + 2 < len(ids)]
            on = on[group[on + 2] == group[on]]
            rank[on] = self.ranks(ids[on], ids[on + 2])
            on = at[at > 0]
            on = on[group[on - 1] == group[on]]
            rank[on - 1] = self.ranks(ids[on - 1], ids[on])
            ids, group, rank = ids[keep], group[keep], rank[keep]
        ids, group = np.concatenate([np.empty(0, np.int64), *out]), np.concatenate([np.empty(0, np.int64), *owner])
        return ids[np.argsort(group, kind="stable")], np.bincount(group, minlength=len(sizes))


def latin_words(lines: str, pattern: re.Pattern, end: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that a pattern finds in lines: their bytes in one array, bytes of each word, number of each word's line.

    Lines are of Latin-1, and the pattern takes the character ``end`` of a line as a word, which is left out here.
    """
    found = pattern.findall(lines)
    points = np.frombuffer("".join(found).encode("latin-1"), np.uint8)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes)
    mark = points[ends - 1] == end
    wide = np.concatenate(([0], np.cumsum(1 + (points >= 0x80).astype(np.int64))))
    raw = np.frombuffer("".join(found).encode(), np.uint8)
    return raw[raw != end], (wide[ends] - wide[ends - sizes])[~mark], np.cumsum(mark)[~mark]
