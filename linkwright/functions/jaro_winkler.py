"""Jaro-Winkler similarity in single precision, by code points.

The window is half the longer length less one and may be empty, so that two equal strings of one
character score 0; the prefix bonus always counts. ``similarity`` is the plain scalar; ``Block``
compares strings of one length with many others at once, keeping for each of these one bit mask of
positions for each character. Pairs without enough letters in common are left out first, by a word of
bits for each string.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

_F = np.float32
#: Longest string whose positions fit into a mask.
MASK_BITS = 63


def similarity(a: str | None, b: str | None, p: float = 0.1) -> float | None:
    """The similarity of two strings; null if either is null, 0 if either is empty."""
    if a is None or b is None:
        return None
    n, m = len(a), len(b)
    reach = max(n, m) // 2 - 1
    free = [True] * m
    of_a = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(m, i + reach + 1)) if free[j] and b[j] == ch), None)
        if j is not None:
            free[j] = False
            of_a.append(ch)
    c = len(of_a)
    if c == 0:
        return 0.0
    of_b = [ch for ch, f in zip(b, free) if not f]
    wrong = sum(x != y for x, y in zip(of_a, of_b))
    same = next((k for k in range(min(4, n, m)) if a[k] != b[k]), min(4, n, m))
    return float(_finish(_F(c), _F(n), _F(m), _F(wrong), _F(same), p))


def _finish(c, n, m, wrong, same, p):  # noqa: ANN001, ANN202
    """The score of match counts, rounded to single precision after every step."""
    total = (c / n + c / m) + (c - wrong / _F(2)) / c
    jaro = (np.asarray(total, np.float64) / 3.0).astype(np.float32)
    return jaro + (_F(p) * same) * (_F(1) - jaro)


def least_jaro(threshold: float, p: float) -> float:
    """No pair below this Jaro similarity reaches the threshold."""
    return (threshold - 4 * p) / (1 - 4 * p) if 4 * p < 1 else -1.0


def length_range(n: int, threshold: float, p: float) -> tuple[int, int | None]:
    """Lengths a partner of a string of ``n`` characters may have; None if there is no upper bound."""
    ratio = 3 * least_jaro(threshold, p) - 2 - 1e-4
    if ratio <= 0:
        return 1, None
    return max(1, int(np.ceil(n * ratio))), int(np.floor(n / ratio))


#: Pairs whose masks are held at once, so that they stay in the cache.
CHUNK_PAIRS = 32_768


class Block:
    """Strings of up to 63 characters, ready to be compared with many others of one length at a time."""

    def __init__(self, values: Sequence[str]) -> None:
        self.values = list(values)
        self.lengths = np.array([len(v) for v in self.values], np.int64)
        codes = _codes(self.values)
        alphabet, letter = np.unique(codes, return_inverse=True)
        row = np.repeat(np.arange(len(self.values)), self.lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        # the last row is that of letters which no string has
        self.masks = np.zeros((len(alphabet) + 1, len(self.values)), np.uint64)
        np.bitwise_or.at(self.masks, (letter, row), np.uint64(1) << at.astype(np.uint64))
        self.alphabet = alphabet
        self.first = np.full(len(self.values), len(alphabet))
        self.first[row[at == 0]] = letter[at == 0]
        # the k-th of equal letters of a string is a mark; two strings have as many letters in common as marks
        marks, of = _marks(letter, row)
        self.marks, column, times = np.unique(marks, return_inverse=True, return_counts=True)
        # usual marks first, so that each of these has a bit of its own in the sketch
        self.rank = np.empty(len(times), np.int64)
        self.rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        self.words = self._words(self.rank[column], of, len(self.values))
        self.sketch = np.bitwise_or.reduce(self.words, axis=0)

    def _words(self, rank: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """The marks of strings as bits, a row for each 64 marks."""
        words = np.zeros((len(self.marks) // 64 + 1, size), np.uint64)
        np.bitwise_or.at(words, (rank // 64, of), np.uint64(1) << (rank % 64).astype(np.uint64))
        return words

    def against(self, xs: Sequence[str], p: float, threshold: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers in ``xs`` and here, and similarities, of the pairs that reach the threshold; ``xs`` are of one length. ``pairs`` are the numbers of those to be compared, all if not given."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        n = len(xs[0]) if len(xs) else 0
        low, high = length_range(n, threshold, p) if n else (1, 0)
        ok = (self.lengths >= low) if high is None else (self.lengths >= low) & (self.lengths <= high)
        if pairs is not None:
            fits = ok[pairs[1]]
            pairs, ok = (pairs[0][fits], pairs[1][fits]), np.full(len(ok), bool(fits.any()))
        chosen = np.flatnonzero(ok)
        if not n or not len(chosen):
            return none
        codes = _codes(xs)
        letters = np.searchsorted(self.alphabet, codes)
        letters[(letters == len(self.alphabet)) | (self.alphabet[np.minimum(letters, len(self.alphabet) - 1)] != codes)] = len(self.alphabet)
        letters = letters.reshape(len(xs), n)
        masks, m = self.masks if len(chosen) == len(self.values) else self.masks[:, chosen], self.lengths[chosen]
        kinds, kind = np.unique(m, return_inverse=True)
        reach = np.maximum(n, kinds) // 2 - 1
        one = np.uint64(1)
        windows = []
        for i in range(n):
            begin, end = np.maximum(0, i - reach), np.maximum(0, np.minimum(kinds, i + reach + 1))
            windows.append(np.where(end > begin, (one << end.astype(np.uint64)) - (one << np.minimum(begin, end).astype(np.uint64)), np.uint64(0))[kind])
        out = []
        for x, y in self._candidates(letters, chosen, kinds, kind, p, threshold, pairs):
            used, hits = np.zeros(len(x), np.uint64), []
            for i in range(n):
                free = masks[letters[x, i], y] & windows[i][y]
                free &= ~used
                bit = free & (~free + one)
                used |= bit
                hits.append(bit)
            c = np.bitwise_count(used).astype(np.int64)
            # what is left to gain: no transposition, four equal first characters
            bound = (c / n + c / m[y] + (c > 0)) / 3
            at = np.flatnonzero((c > 0) & (bound + 4 * p * (1 - bound) >= threshold - 1e-4))
            if not len(at):
                continue
            x, y, rest, c = x[at], y[at], used[at], c[at]
            wrong, same, going = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.ones(len(x), bool)
            for i in range(n):
                own = masks[letters[x, i], y]
                if i < 4:
                    going &= (own >> np.uint64(i)) & one == 1
                    same += going
                hit = hits[i][at] != 0
                lowest = rest & (~rest + one)
                wrong += hit & ((own & lowest) == 0)
                rest = np.where(hit, rest ^ lowest, rest)
            f = lambda v: v.astype(np.float32)
            score = _finish(f(c), _F(n), f(m[y]), f(wrong), f(same), p)
            keep = np.flatnonzero(score >= _F(threshold))
            out.append((x[keep], chosen[y[keep]], score[keep]))
        return tuple(np.concatenate(v) for v in zip(*out)) if out else none

    def _candidates(self, letters: np.ndarray, chosen: np.ndarray, kinds: np.ndarray, kind: np.ndarray, p: float, threshold: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the pairs, a chunk at a time, that have enough letters in common, wherever they stand, for their equal first characters."""
        rows, n = letters.shape
        marks, of = _marks(letters.ravel(), np.repeat(np.arange(rows), n))
        column = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        known = self.marks[column] == marks
        words = self._words(self.rank[column[known]], of[known], rows)
        masks = self.masks if len(chosen) == len(self.values) else self.masks[:, chosen]
        lacking, others = ~np.bitwise_or.reduce(words, axis=0), self.words[:, chosen]
        sketch, m = self.sketch[chosen], self.lengths[chosen]
        c = np.arange(n + 1)[:, None]
        jaro = (c / n + c / np.maximum(kinds, 1) + (c > 0)) / 3
        # by equal first characters and length, so many letters are needed; n + 1 if no number is enough
        need = np.array([np.where((ok := (c > 0) & (jaro + k * p * (1 - jaro) >= threshold - 1e-4)).any(axis=0), ok.argmax(axis=0), n + 1) for k in range(5)], np.int64)[:, kind]
        if pairs is not None:
            x, y = pairs
            near = np.flatnonzero(np.bitwise_count(lacking[x] & sketch[y]) <= m[y] - need[4][y])
            source = [(x[near], y[near])]
        else:
            source = self._sketched(lacking, sketch, m, need, letters[:, 0], self.first[chosen])
        for x, y in source:
            for begin in range(0, len(x), CHUNK_PAIRS):
                i, j = x[begin : begin + CHUNK_PAIRS], y[begin : begin + CHUNK_PAIRS]
                both = np.zeros(len(i), np.int64)
                for w in range(len(words)):
                    both += np.bitwise_count(words[w, i] & others[w, j])
                enough = both >= need[4, j]
                i, j, both = i[enough], j[enough], both[enough]
                same, going = np.zeros(len(i), np.int64), np.ones(len(i), bool)
                for k in range(min(4, n)):
                    going &= (masks[letters[i, k], j] >> np.uint64(k)) & np.uint64(1) == 1
                    same += going
                enough = both >= need[same, j]
                if enough.any():
                    yield i[enough], j[enough]

    @staticmethod
    def _sketched(lacking: np.ndarray, sketch: np.ndarray, m: np.ndarray, need: np.ndarray, first_x: np.ndarray, first_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the pairs whose sketches allow enough letters in common.

        Each bit of one sketch that the other lacks is a mark of its own. Pairs with different first
        characters gain nothing by these and need more letters than those with the same.
        """

        def near(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            y = y[least[y] <= m[y]]
            if not len(x) or not len(y):
                return
            bits, spare = sketch[y], (m[y] - least[y]).astype(np.uint8)
            step = min(len(x), max(1, CHUNK_PAIRS // len(y)))
            both, count, close = (np.empty((step, len(y)), t) for t in (np.uint64, np.uint8, bool))
            for begin in range(0, len(x), step):
                part = x[begin : begin + step]
                rows = slice(0, len(part))
                np.bitwise_and(lacking[part, None], bits, out=both[rows])
                np.bitwise_count(both[rows], out=count[rows])
                np.less_equal(count[rows], spare, out=close[rows])
                at = np.flatnonzero(close[rows])
                if len(at):
                    yield part[at // len(y)], y[at % len(y)]

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = 0
        ways = [(np.arange(len(lacking)), np.arange(len(sketch)), need[0], True)]
        ways += [(np.flatnonzero(first_x == letter), np.flatnonzero(first_y == letter), need[4], False) for letter in np.unique(first_x)]
        for xs, ys, least, apart in ways:
            for x, y in near(xs, ys, least):
                if apart:
                    other = first_x[x] != first_y[y]
                    x, y = x[other], y[other]
                kept.append((x, y))
                pairs += len(x)
                if pairs >= CHUNK_PAIRS:
                    yield tuple(np.concatenate(v) for v in zip(*kept))
                    kept, pairs = [], 0
        if pairs:
            yield tuple(np.concatenate(v) for v in zip(*kept))


def _marks(letter: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each string a number of the letter and of how many equal ones stand before it; and the string."""
    order = np.lexsort((letter, row))
    letter, row = letter[order].astype(np.int64), row[order]
    starts = np.ones(len(letter), bool)
    starts[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(letter))
    return letter * (MASK_BITS + 1) + at - np.maximum.accumulate(np.where(starts, at, 0)), row


def _codes(values: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)


def block_pairs(xs: Sequence[str], ys: Sequence[str], p: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in ``xs`` and ``ys``, and similarities, of all pairs with at least the threshold.

    Strings beyond 63 characters are compared one by one.
    """
    short = [i for i, y in enumerate(ys) if len(y) <= MASK_BITS]
    long = [i for i, y in enumerate(ys) if len(y) > MASK_BITS]
    block, at = Block([ys[i] for i in short]), np.array(short, np.int64)
    by_length: dict[int, list[int]] = {}
    single: list[tuple[int, int, np.float32]] = []
    for i, x in enumerate(xs):
        if len(x) <= MASK_BITS:
            by_length.setdefault(len(x), []).append(i)
        others = long if len(x) <= MASK_BITS else range(len(ys))
        single += [(i, j, s) for j in others if (s := _F(similarity(x, ys[j], p))) >= _F(threshold)]
    found = [(np.array([i for i, _, _ in single], np.int64), np.array([j for _, j, _ in single], np.int64), np.array([s for *_, s in single], np.float32))]
    for numbers in by_length.values():
        x, y, score = block.against([xs[i] for i in numbers], p, threshold)
        found.append((np.array(numbers, np.int64)[x], at[y], score))
    return tuple(np.concatenate(v) for v in zip(*found))


class Sketches:
    """A word of bits for each of two lists of strings, by which most pairs are seen not to reach the threshold."""

    def __init__(self, xs: Sequence[str], ys: Sequence[str], p: float, threshold: float) -> None:
        short = [[v if len(v) <= MASK_BITS else "" for v in vs] for vs in (xs, ys)]
        block = Block(short[1])
        codes, size = _codes(short[0]), np.array([len(v) for v in short[0]], np.int64)
        # a letter that no string of the second list has is no mark there
        letter = np.searchsorted(block.alphabet, codes)
        known = letter < len(block.alphabet)
        known[known] = block.alphabet[letter[known]] == codes[known]
        marks, of = _marks(letter[known], np.repeat(np.arange(len(xs)), size)[known])
        column = np.minimum(np.searchsorted(block.marks, marks), max(len(block.marks) - 1, 0))
        here = block.marks[column] == marks if len(block.marks) else np.zeros(0, bool)
        self.lacking = ~np.bitwise_or.reduce(block._words(block.rank[column[here]], of[here], len(xs)), axis=0)
        self.sketch = block.sketch
        # by both lengths, so many marks of the second string may be lacking; the last row and column are strings that are not looked at here
        self.lengths = [np.array([min(len(v), MASK_BITS + 1) for v in vs], np.int64) for vs in (xs, ys)]
        self.spare = np.full((MASK_BITS + 2, MASK_BITS + 2), -1, np.int8)
        for n in range(1, MASK_BITS + 1):
            c, m = np.arange(1, n + 1)[:, None], np.arange(1, MASK_BITS + 1)
            jaro = (c / n + c / m + 1) / 3
            ok = jaro + 4 * p * (1 - jaro) >= threshold - 1e-4
            self.spare[n, 1:-1] = np.where(ok.any(axis=0), np.maximum(m - ok.argmax(axis=0) - 1, -1), -1)
        self.spare[-1], self.spare[:, -1] = 64, 64

    def of(self, x: np.ndarray, y: np.ndarray) -> Sketches:
        """The same for rows that have these numbers."""
        out = object.__new__(Sketches)
        out.lacking, out.sketch, out.spare = self.lacking[x], self.sketch[y], self.spare
        out.lengths = [self.lengths[0][x], self.lengths[1][y]]
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs of these numbers may reach the threshold."""
        return np.bitwise_count(self.lacking[i] & self.sketch[j]) <= self.spare[self.lengths[0][i], self.lengths[1][j]]


def pair_levels(xs: Sequence[str], ys: Sequence[str], x: np.ndarray, y: np.ndarray, p: float, lower: float, upper: float) -> np.ndarray:
    """The level, 0 to 2, of each pair of the numbers ``x`` in ``xs`` and ``y`` in ``ys``; an empty string reaches none."""
    if 4 * len(y) < len(ys):
        # a few pairs need few of the strings
        used, y = np.unique(y, return_inverse=True)
        ys = [ys[i] for i in used]
    out = np.zeros(len(x), np.int64)
    size_x, size_y = (np.array([len(v) for v in vs], np.int64) for vs in (xs, ys))
    level = lambda score: (score >= _F(lower)).astype(np.int64) + (score >= _F(upper))
    for i in np.flatnonzero((size_x[x] > MASK_BITS) | (size_y[y] > MASK_BITS)):
        out[i] = level(np.float32(similarity(xs[x[i]], ys[y[i]], p)))
    # strings beyond the masks have been compared; an empty one stands in their place
    block, n = Block([v if len(v) <= MASK_BITS else "" for v in ys]), np.where(size_y[y] > MASK_BITS, 0, size_x[x])
    order = np.argsort(n, kind="stable")
    lengths, begins = np.unique(n[order], return_index=True)
    for length, begin, end in zip(lengths, begins, [*begins[1:], len(order)]):
        if not 0 < length <= MASK_BITS:
            continue
        at = order[begin:end]
        used, i = np.unique(x[at], return_inverse=True)
        # the place of a pair is found by its numbers again; a pair may come more than once
        key, back = np.unique(i * len(ys) + y[at], return_inverse=True)
        scores = np.zeros(len(key), np.float32)
        i, j, score = block.against([xs[k] for k in used], p, lower, (key // len(ys), key % len(ys)))
        scores[np.searchsorted(key, i * len(ys) + j)] = score
        out[at] = level(scores)[back]
    return out


def pair_scores(a: Sequence[str | None], b: Sequence[str | None], p: float) -> np.ndarray:
    """The similarity of each pair of two lists, NaN where a side is null; equal pairs are compared once."""
    missing = np.array([not isinstance(u, str) or not isinstance(v, str) for u, v in zip(a, b)], bool)
    partners: dict[str, dict[str, float]] = {}
    for u, v, gone in zip(a, b, missing):
        if not gone:
            partners.setdefault(u, {})[v] = 0.0
    for u, of in partners.items():
        ys = list(of)
        _, j, score = block_pairs([u], ys, p, 0.0) if len(ys) > 4 else (None, range(len(ys)), [similarity(u, y, p) for y in ys])
        for at, s in zip(j, score):
            of[ys[at]] = float(s)
    return np.array([np.nan if gone else partners[u][v] for u, v, gone in zip(a, b, missing)], np.float32)


def jw_similarity(a: Column, b: Column, p: float = 0.1) -> Column:
    """The similarity of two string columns, row by row, as a float; null where either is null."""

    @pandas_udf("float")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _as_series(pair_scores(x.tolist(), y.tolist(), p))

    return run(a, b)


def _as_series(scores: np.ndarray) -> pd.Series:
    return pd.Series(scores, dtype="float32").where(~np.isnan(scores), None)


def register(spark: SparkSession, p: float = 0.1, lower: float = 0.88, upper: float = 0.94) -> None:
    """Make ``jw_similarity(a, b)`` and ``jw_level(a, b)`` functions of SQL."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return _as_series(pair_scores(x.tolist(), y.tolist(), p))

    def level(x: pd.Series, y: pd.Series) -> pd.Series:
        s = pair_scores(x.tolist(), y.tolist(), p)
        return pd.Series((s >= _F(lower)).astype("int32") + (s >= _F(upper)).astype("int32"))

    spark.udf.register("jw_similarity", pandas_udf(score, "float"))
    spark.udf.register("jw_level", pandas_udf(level, "int"))
