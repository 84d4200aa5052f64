"""A true edit metric on many pairs of words at once, and the cells of a metric space in memory."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_U = np.uint64
#: Longest word whose positions fit into a mask.
MASK_BITS = 63
#: A word is drawn as a pivot so that ``n`` words have about ``sqrt(n) / PIVOT_PART`` of them besides the first.
PIVOT_PART = 2.0


class Words:
    """Words as rows of code points."""

    def __init__(self, words: Sequence[str]) -> None:
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.zeros((len(words), int(self.lengths.max(initial=1))), np.uint32)
        row = np.repeat(np.arange(len(words)), self.lengths)
        self.codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)] = flat

    def hashes(self) -> np.ndarray:
        """A number in [0, 1) for each word, the same wherever the word occurs."""
        h = np.zeros(len(self.words), _U)
        for j in range(self.codes.shape[1]):
            here = self.lengths > j
            h = np.where(here, (h ^ self.codes[:, j]) * _U(0x9E3779B97F4A7C15), h)
            h ^= h >> _U(29)
        return (h >> _U(11)).astype(np.float64) / float(1 << 53)

    def letters(self) -> np.ndarray:
        """The set of each word's letters, as bits; several letters may share one."""
        out = np.zeros(len(self.words), _U)
        for j in range(self.codes.shape[1]):
            out |= np.where(self.lengths > j, _U(1) << (self.codes[:, j] % 61).astype(_U), _U(0))
        return out

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Levenshtein distances of the words ``i`` to the words ``j``, a bit for each letter of ``i``."""
        out = np.zeros(len(i), np.int64)
        longest = np.maximum(self.lengths[i], self.lengths[j])
        for low, high in ((0, 8), (8, 16), (16, MASK_BITS)):
            part = np.flatnonzero((longest > low) & (longest <= high))
            # pieces that stay in the cache
            for at in range(0, len(part), 20_000):
                chosen = part[at : at + 20_000]
                out[chosen] = self._by_bits(i[chosen], j[chosen])
        for at in np.flatnonzero(longest > MASK_BITS):
            out[at] = _plain(self.words[i[at]], self.words[j[at]])
        return out

    def _by_bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m, n = self.lengths[i], self.lengths[j]
        width = int(m.max())
        pattern, text = self.codes[i, :width], self.codes[j, : int(n.max())]
        pattern = np.where(np.arange(width) < m[:, None], pattern, np.uint32(0xFFFFFFFF))
        weight = _U(1) << np.arange(width, dtype=_U)
        plus, minus = np.full(len(i), ~_U(0)), np.zeros(len(i), _U)
        score, top = m.copy(), np.maximum(m - 1, 0).astype(_U)
        one = _U(1)
        for k in range(text.shape[1]):
            equal = ((pattern == text[:, k][:, None]) * weight).sum(axis=1, dtype=_U)
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(across | plus)
            fall = plus & across
            step = ((up >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64)
            score += np.where(k < n, step, 0)
            up, fall = (up << one) | one, fall << one
            plus, minus = fall | ~(down | up), up & down
        return np.where(m == 0, n, score)


def _plain(a: str, b: str) -> int:
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def _cross(left: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element of ``left`` with all places from its ``begin``, ``size`` many."""
    times = size
    x = np.repeat(left, times)
    return x, np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)


def close_words(words: Sequence[str], group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all pairs of different words of one group within the radius, and the number of cells.

    ``group`` rises; a group's words are distinct. Pivots are drawn by hash, a word goes to the cell
    of its nearest pivot and, by the triangle inequality, to those of all pivots not more than twice
    the radius farther; two words within the radius meet in the home cell of either.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, 0
    w = Words(words)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    number = np.repeat(np.arange(len(starts)), sizes)
    h = w.hashes()
    pivot = h * np.sqrt(sizes[number]) * PIVOT_PART < 1
    least = np.minimum.reduceat(h, starts)
    pivot |= h == least[number]
    pivots = np.flatnonzero(pivot)
    n_pivots = np.add.reduceat(pivot, starts, dtype=np.int64)
    first_pivot = np.cumsum(n_pivots) - n_pivots
    # every word meets the pivots of its group
    x, at = _cross(np.arange(len(words)), first_pivot[number], n_pivots[number])
    d = w.distances(x, pivots[at])
    begin = np.cumsum(n_pivots[number]) - n_pivots[number]
    near = np.minimum.reduceat(d, begin)
    first = np.full(len(words), len(d))
    hit = np.flatnonzero(d == near[x])
    np.minimum.at(first, x[hit], hit)
    inside = np.flatnonzero(d <= near[x] + 2 * radius)
    order = inside[np.argsort(at[inside], kind="stable")]
    member, cell, far, home = x[order], at[order], d[order], first[x[order]] == order
    cell_start = np.searchsorted(cell, np.arange(len(pivots)))
    cell_size = np.searchsorted(cell, np.arange(len(pivots)), side="right") - cell_start
    homes = np.flatnonzero(home)
    found = []
    for part in np.array_split(homes, max(1, int(cell_size[cell[homes]].sum()) // 2_000_000 + 1)):
        a, b = _cross(part, cell_start[cell[part]], cell_size[cell[part]])
        ok = (member[a] != member[b]) & (np.abs(far[a] - far[b]) <= radius) & (np.abs(w.lengths[member[a]] - w.lengths[member[b]]) <= radius)
        p, q = member[a[ok]], member[b[ok]]
        ok = w.distances(p, q) <= radius
        found.append(np.stack([np.minimum(p[ok], q[ok]), np.maximum(p[ok], q[ok])]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1], len(pivots)
