"""Matching blocks of two texts, as difflib has them without junk."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Cells of one text by the other, and equal ones among them, that are held at once; beyond, difflib itself is asked.
MOST_CELLS, MOST_EQUAL = 1 << 26, 1 << 21
#: Runs that are looked through one by one.
FEW = 24


def _runs(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Where the longest runs of equal characters along each diagonal begin in a and b, and their lengths."""
    n, wide = len(a), len(b) + 1
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    # a column and a row of no cells behind, so that a step along a diagonal never meets another one
    same = np.zeros((n + 1, wide), bool)
    np.equal(x[:, None], y[None, :], out=same[:n, :-1])
    same = same.reshape(-1)
    if np.count_nonzero(same) > MOST_EQUAL:
        return None
    equal = np.flatnonzero(same)
    first, last = equal[~same[equal - wide - 1]], equal[~same[equal + wide + 1]]
    (i, j), (k, l) = np.divmod(first, wide), np.divmod(last, wide)
    short = np.int16 if n + wide < 1 << 15 else np.int64
    begins, ends = (np.argsort((q - p).astype(short), kind="stable") for p, q in ((i, j), (k, l)))
    i, j = i[begins].astype(np.int32), j[begins].astype(np.int32)
    return i, j, k[ends].astype(np.int32) - i + 1


def _few(i: list[int], j: list[int], size: list[int], out: list[tuple[int, int, int]]) -> None:
    todo = [list(zip(size, i, j, strict=True))]
    while todo:
        runs = todo.pop()
        n, x, y = min(runs, key=lambda r: (-r[0], r[1], r[2]))
        out.append((x, y, n))
        left = [(k, p, q) for s, p, q in runs if p < x and q < y and (k := min(s, x - p, y - q)) > 0]
        right = [(s - k, p + k, q + k) for s, p, q in runs if (k := max(0, x + n - p, y + n - q)) < s]
        todo += [part for part in (left, right) if part]


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Place in a, place in b and size of each block, in order: the longest common block (of equal ones the first in a, then
    in b), then those of the parts before and behind it; blocks that touch in both texts are one."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    if not a or not b:
        return []
    runs = _runs(a, b) if len(a) * len(b) <= MOST_CELLS else None
    if runs is None:
        return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    out: list[tuple[int, int, int]] = []
    todo = [runs] if len(runs[0]) else []
    while todo:
        i, j, size = todo.pop()
        if len(i) <= FEW:
            _few(i.tolist(), j.tolist(), size.tolist(), out)
            continue
        longest = np.flatnonzero(size == size.max())
        at = longest[np.lexsort((j[longest], i[longest]))[0]] if len(longest) > 1 else longest[0]
        x, y, n = int(i[at]), int(j[at]), int(size[at])
        out.append((x, y, n))
        # what is left of each run before the block, and behind it
        left = np.minimum(np.minimum(x - i, y - j), size)
        some = np.flatnonzero(left > 0)
        if len(some):
            todo.append((i[some], j[some], left[some]))
        gone = np.maximum(np.maximum(x + n - i, y + n - j), 0)
        some = np.flatnonzero(gone < size)
        if len(some):
            gone = gone[some]
            todo.append((i[some] + gone, j[some] + gone, size[some] - gone))
    merged: list[tuple[int, int, int]] = []
    for x, y, n in sorted(out):
        if merged and merged[-1][0] + merged[-1][2] == x and merged[-1][1] + merged[-1][2] == y:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((x, y, n))
    return merged


def blocks_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks, as a share of both texts."""
    both = len(a) + len(b)
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / both if both else 1.0
