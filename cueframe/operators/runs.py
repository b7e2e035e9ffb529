"""The run of timed words that a text matches best, by branch and bound.

Runs are ranked by the matching-blocks ratio less penalties that are known beforehand. Running counts of
characters bound every run's matches from above at once; runs are tried by falling bound until none that is
left can win. A run that is tried is opened block by block: its longest common block parts it into two
rectangles of text against words, which are bounded in turn, and it is given up as soon as their bounds are
too small. Rectangles are shared: what lies left of a block does not hang on where the run ends, nor what
lies right of it on where it begins.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import cached_property
from itertools import accumulate

import numpy as np

#: Cells of text by words that are held as a matrix; beyond, each run that is tried is matched alone.
MOST_CELLS = 1 << 26


class Blocks:
    """Characters in matching blocks between parts of two texts: the longest common block first (of equal ones
    the first in a, then in b), then the parts before and behind it, as difflib has it without junk."""

    def __init__(self, a: str, b: str):
        self.n, self.m = len(a), len(b)
        alphabet = {c: i for i, c in enumerate(sorted(set(a)))}
        codes = [np.array([alphabet.get(c, -1 - k) for c in t], np.int32) for k, t in ((0, a), (1, b))]
        self.counts = [np.concatenate([np.zeros((1, len(alphabet)), np.int32), np.cumsum(x[:, None] == np.arange(len(alphabet)), axis=0, dtype=np.int32)]) for x in codes]
        # length of the common block that ends at each pair of characters
        self.ends = np.zeros((self.n, self.m), np.int16 if min(self.n, self.m) < 1 << 15 else np.int32)
        row = np.zeros(self.m + 1, self.ends.dtype)
        for i in range(self.n):
            row[1:] = np.where(codes[1] == codes[0][i], row[:-1] + 1, 0)
            self.ends[i] = row[1:]
        self.cap = np.arange(1, max(self.n, self.m) + 1, dtype=self.ends.dtype)
        self.longest_of_all = int(self.ends.max(initial=0))
        self.known: dict[tuple[int, int, int, int], int] = {}
        self.below: dict[tuple[int, int, int, int], int] = {}  # no more than this
        self.block: dict[tuple[int, int, int, int], tuple[int, int, int]] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * (self.n + self.m) + 1000))

    def bound(self, rect: tuple[int, int, int, int]) -> int:
        """Characters that both parts hold, in any order."""
        if (known := self.known.get(rect)) is not None:
            return known
        if (found := self.below.get(rect)) is None:
            i, j, k, l = rect
            found = 0 if i == j or k == l else int(np.minimum(self.counts[0][j] - self.counts[0][i], self.counts[1][l] - self.counts[1][k]).sum())
            self.below[rect] = found
        return found

    def longest(self, rect: tuple[int, int, int, int]) -> tuple[int, int, int]:
        """Size of the longest common block, and where it begins in a and b."""
        if (found := self.block.get(rect)) is None:
            i, j, k, l = rect
            part = self.ends[i:j, k:l].copy()
            edge = self.longest_of_all
            # a block that began before the part counts from the part's edge
            np.minimum(part[:edge], self.cap[: min(edge, j - i), None], out=part[:edge])
            np.minimum(part[:, :edge], self.cap[None, : min(edge, l - k)], out=part[:, :edge])
            at = int(part.argmax())
            size = int(part.flat[at])
            found = self.block[rect] = size, i + at // (l - k) - size + 1, k + at % (l - k) - size + 1
        return found

    def at_least(self, rect: tuple[int, int, int, int], need: int) -> int | None:
        """The number of matching characters, or none if it is smaller than need."""
        most = self.bound(rect)
        if most < need or not most:
            return None if most < need else 0
        if rect in self.known:
            return most
        i, j, k, l = rect
        size, a, b = self.longest(rect)
        left, right = (i, a, k, b), (a + size, j, b + size, l)
        rest = self.bound(right)
        first = self.at_least(left, need - size - rest) if size else 0
        second = self.at_least(right, need - size - first) if size and first is not None else 0
        if first is None or second is None:
            self.below[rect] = min(self.below[rect], size + self.bound(left) + self.bound(right), need - 1)
            return None
        self.known[rect] = size + first + second
        return self.known[rect]


class Score:
    """The ratio of a text to runs of words: the share of the longer one if one holds the other, else by blocks."""

    def __init__(self, text: str, words: str):
        self.text, self.words = text, words

    @cached_property
    def blocks(self) -> Blocks | None:
        """Made once a run is neither a part of the text nor holds it."""
        return Blocks(self.text, self.words) if len(self.text) * len(self.words) <= MOST_CELLS else None

    def at_least(self, start: int, end: int, need: float) -> float | None:
        """The score of words[start:end], or none if it is smaller than need."""
        run, n = self.words[start:end], len(self.text)
        if not run:
            return None if need > 0 else 0.0
        both = n + len(run)
        if run in self.text or self.text in run:
            return min(n, len(run)) / max(n, len(run))
        if self.blocks is None:
            return SequenceMatcher(None, self.text, run, autojunk=False).ratio()
        found = self.blocks.at_least((0, n, start, end), int(np.ceil(need * both / 2 - 1e-6)))
        return None if found is None else 2.0 * found / both


class Words:
    """Timed words of a recording, (start, end, text, probability), in order of time."""

    def __init__(self, words: list[tuple], fold=None):
        self.words, self.starts = words, [w[0] for w in words]
        self.latest = list(accumulate((w[1] for w in words), max))
        self.fold = fold

    def near(self, start: float, end: float, used: int) -> list[int]:
        first = max(used, bisect_left(self.latest, start))
        return [k for k in range(first, bisect_right(self.starts, end)) if self.words[k][1] >= start]


def _windows(near: list[int], sizes: np.ndarray, fewest: int, most: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of neighbouring words, by place in near."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    place, count = np.arange(len(near)), len(near)
    broken = np.flatnonzero(np.diff(near) != 1) + 1
    stop = np.append(broken, count)[np.searchsorted(broken, place, "right")]  # where neighbours end
    low = np.maximum(place + 1, np.searchsorted(upto, upto[:-1] + fewest, "left"))
    high = np.minimum.reduce([np.searchsorted(upto, upto[:-1] + most, "right") - 1, stop, place + many])
    n = np.maximum(0, high - low + 1)
    first = np.repeat(place, n)
    return first, np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def best_run(text: str, start: float, end: float, words: Words, used: int, margin: float, least: float, per_second: float, per_character: float) -> tuple[float, int, int] | None:
    """Score and first and last word of the run of neighbouring words near (start, end), from word `used` on, that
    ranks best: score - per_second * distance of the middles - per_character * difference of lengths; of equal ranks
    the one that starts first. None if its score is below least."""
    near = words.near(start - margin, end + margin, used)
    if not text or not near:
        return None
    n, middle = len(text), (start + end) / 2
    parts = [words.words[k][2] for k in near]
    sizes = np.array([len(p) for p in parts], np.int64)
    a, b = _windows(near, sizes, max(1, int(n * 0.45)), max(n + 4, int(n * 1.75)), max(8, 2 * n + 4))
    if not len(a):
        return None
    upto = np.concatenate([[0], np.cumsum(sizes)])
    joined = "".join(parts)
    texts = [(text, joined)]
    if words.fold and (folded := (words.fold(text), words.fold(joined))) != texts[0]:
        texts.append(folded)
    size = upto[b] - upto[a]
    begins = np.array([words.words[k][0] for k in near])
    ends = np.array([words.words[k][1] for k in near])
    far, other = per_second * np.abs((begins[a] + ends[b - 1]) / 2 - middle), per_character * np.abs(size - n)
    bounds = np.zeros(len(a))
    for t, j in texts:
        letters = sorted(set(t))
        codes = np.array([letters.index(c) if c in letters else -1 for c in j])
        own = np.array([t.count(c) for c in letters])
        counts = np.concatenate([np.zeros((1, len(letters)), np.int64), np.cumsum(codes[:, None] == np.arange(len(letters)), axis=0)])[upto]
        shared = np.concatenate([np.minimum(counts[b[i : i + 65536]] - counts[a[i : i + 65536]], own).sum(axis=1) for i in range(0, len(a), 65536)])
        bounds = np.maximum(bounds, 2.0 * shared / (n + size))
    scores = [Score(*t) for t in texts]
    best: tuple[float, float, int] | None = None
    top = None

    def attempt(w: int, least_score: float) -> None:
        nonlocal best, top
        need = max(least_score, best[0] + far[w] + other[w] - 1e-9 if best else 0.0)
        found = [s for x in scores if (s := x.at_least(int(upto[a[w]]), int(upto[b[w]]), need)) is not None]
        if not found:
            return
        rank = (float(max(found) - far[w] - other[w]), -float(begins[a[w]]), -w)
        if best is None or rank > best:
            best, top = rank, (max(found), near[a[w]], near[b[w] - 1])

    ranks = bounds - far - other
    for w in np.argsort(-ranks, kind="stable"):
        if best and ranks[w] < best[0]:
            break
        if bounds[w] >= least:
            attempt(w, least)
    if top is None or top[0] < least:
        return None
    # runs whose score is too low may still rank higher, and then nothing is proposed
    for w in np.flatnonzero(np.minimum(bounds, least) - far - other >= best[0]):
        attempt(w, 0.0)
    return top if top[0] >= least else None
