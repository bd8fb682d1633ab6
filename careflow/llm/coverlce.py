"""Longest common extensions over word codes, from suffixes sampled by a difference cover.

Only the positions whose remainder modulo v lies in the cover are sorted. For any two positions
some shift below v brings both onto sampled ones, so a query compares at most v - 1 words and
then looks up one range minimum over the common prefixes of neighbouring sampled suffixes.
"""

from __future__ import annotations

import numpy as np

# Perfect difference sets. Every residue is a difference of two members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
# Words per step to the next larger cover; the sampled table takes about this many rows then.
SAMPLES = 1 << 20


def cover_for(n: int) -> int:
    """The smallest modulus whose cover samples at most SAMPLES of n positions, or the largest one."""
    return next((v for v, cover in COVERS.items() if n * len(cover) <= SAMPLES * v), max(COVERS))


class CoverLce:
    """`codes` are whole numbers of which every text is closed by one that occurs nowhere else;
    `owner` is the text of each position. Queries are for two different positions of one text."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, v: int | None = None):
        n, v = len(codes), v or cover_for(len(codes))
        cover = np.array(COVERS[v])
        self.v = v
        self.codes = np.concatenate([codes, np.full(v, -1)])
        member = np.zeros(v, bool)
        member[cover] = True
        self.shift = self._shifts(member)
        places = np.arange(n)
        self.at = np.flatnonzero(member[places % v])
        self.index = np.full(n + 1, -1, np.int64)
        self.index[self.at] = np.arange(len(self.at))
        self._sort(owner, n)

    def _shifts(self, member: np.ndarray) -> np.ndarray:
        v, steps = self.v, np.arange(self.v)
        sampled = member[(steps[:, None] + steps) % v]  # residue, shift
        both = sampled[:, None, :] & sampled[None, :, :]
        return both.argmax(2)

    def _sort(self, owner: np.ndarray, n: int) -> None:
        """Ranks of the sampled suffixes by doubling over blocks of v words. Texts never share a rank,
        so copies of a text cost no further round."""
        at, v = self.at, self.v
        keys = [owner[at]]
        bits = max(1, int(self.codes.max()).bit_length() + 1)
        each = max(1, 62 // bits)
        for t in range(0, v, each):
            key = np.zeros(len(at), np.int64)
            for s in range(t, min(t + each, v)):
                key = (key << bits) | (self.codes[at + s] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), np.int64)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], v
        while len(at) and rank.max() + 1 < len(at):
            after = np.minimum(at + step, n)
            follow = np.where(self.index[after] >= 0, rank[self.index[after]], -1) + 1
            rank = np.unique(rank * (len(at) + 1) + follow, return_inverse=True)[1]
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        a, b = at[order[:-1]], at[order[1:]]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = self.index[np.minimum(a + length, n)], self.index[np.minimum(b + length, n)]
            same = (x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y])
            length += np.where(same, v << k, 0)
        length, _ = self._compare(a, b, length, np.full(len(a), v))
        table = [length]
        while 2 << (len(table) - 1) <= len(length):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def _compare(self, a: np.ndarray, b: np.ndarray, done: np.ndarray, most: np.ndarray):
        """Adds up to `most` equal words from a + done and b + done; also where all were equal."""
        done, end, n = done.copy(), done + most, len(self.codes) - 1
        live = np.flatnonzero(done < end)
        whole = np.ones(len(done), bool)
        while len(live):
            x, y = np.minimum(a[live] + done[live], n), np.minimum(b[live] + done[live], n)
            same = (self.codes[x] == self.codes[y]) & (self.codes[x] >= 0)
            whole[live[~same]] = False
            live = live[same]
            done[live] += 1
            live = live[done[live] < end[live]]
        return done, whole

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common, of positions of one text."""
        shift = self.shift[a % self.v, b % self.v]
        length, whole = self._compare(a, b, np.zeros(len(a), np.int64), shift)
        far = np.flatnonzero(whole)
        if len(far):
            x, y = self.rank[self.index[a[far] + shift[far]]], self.rank[self.index[b[far] + shift[far]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the binary logarithm
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                of, row = np.flatnonzero(level == k), self.table[k]
                least[of] = np.minimum(row[low[of]], row[high[of] - (1 << int(k))])
            length[far] += least
        return length
