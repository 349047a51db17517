"""Runs of repeated word blocks, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(MIN_WORDS, MIN_EXPONENT * q)`` that no neighbouring word extends.

*Stretches.* In such a run every window of ``WINDOW`` words comes back within q words, and q is at most a third of the run. Windows are hashed
over the whole text; positions whose nearest equal window is farther than a third of the stretch of such positions around them are struck out, again and again while that changes anything.
Most texts have no stretch left and no run; what is left goes to the automaton, word by word (hash collisions only add stretches).

*Automaton.* The words of a stretch are appended to a suffix automaton. Its suffix links form a tree in which the path from the state of a prefix to the root holds all
suffixes of that prefix. For each word the path is accessed in a link-cut tree: it becomes one preferred path, coloured by the word's position, and on the way falls into the
segments that were coloured by earlier accesses. A segment's colour is the last place at which its suffixes ended. Where the distance p from
there is at most the segment's longest suffix, two equal blocks of p words meet: a square of period p, whose root is primitive since the last place is the nearest.
Every such square is met, in n log n steps altogether. The first square of a run is extended to the right; later ones are inside it.

Results: null, empty and blank texts have no words and no runs, and ``collapsed`` is empty; other texts keep their words joined by one space, less those that any run contains after
its first q words. Runs are sorted by start, then period; ``best`` is the run with the greatest length / period (ties: smallest start, then period), null without runs. Equal texts have equal
results; an empty table gives an empty result. Texts are judged whole, one at a time; memory is about 500 bytes for each word of the longest stretch.
An input column named like the output is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

MIN_WORDS = 24
MIN_EXPONENT = 3
#: Words of a hashed window; runs of MIN_WORDS words and three periods repeat each window of this size.
WINDOW = 8
#: Positions are struck out so often at most; whatever is left is searched.
STRIKE_ROUNDS = 16
MEMO_WORDS = 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FAR = np.iinfo(np.int64).max
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_KIND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, best: struct<start: bigint, length: bigint, period: bigint>, collapsed: string>"


class _Numbers(dict):
    """Words to consecutive numbers."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _windows(words: np.ndarray) -> np.ndarray:
    """A hash of each ``WINDOW`` words, by doubling the width."""
    h = (words.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(29)
    width = 1
    for mul in _MIX[1:]:
        h = h[:-width] * mul + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    return h


def _bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of true flags."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] - 1


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges (start, end) outside of which there is no run."""
    if len(words) < MIN_WORDS:
        return []
    h = _windows(words)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    gap = (order[1:] - order[:-1])[same]
    near = np.full(len(h), _FAR)
    near[order[1:][same]] = gap
    before = order[:-1][same]
    near[before] = np.minimum(near[before], gap)
    alive = near < _FAR
    for _ in range(STRIKE_ROUNDS):
        first, last = _bounds(alive)
        size = last - first + WINDOW
        allowed = np.zeros(len(h), np.int64)
        allowed[alive] = np.repeat(np.where(size >= MIN_WORDS, size // MIN_EXPONENT, 0), last - first + 1)
        still = alive & (near <= allowed)
        if (still == alive).all():
            break
        alive = still
    first, last = _bounds(alive)
    return list(zip(first.tolist(), (last + WINDOW).tolist()))


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest suffix and suffix link of each state of the suffix automaton, and the state of each prefix."""
    step, longest, link, ends, last = [{}], [0], [-1], [], 0
    for i, word in enumerate(words, 1):
        new = len(step)
        step.append({})
        longest.append(i)
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(step[to].copy())
                longest.append(longest[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
        ends.append(new)
        last = new
    return longest, link, ends


class AccessTree:
    """Link-cut tree over the suffix links: preferred paths as splay trees, each with one colour, kept at the splay root."""

    def __init__(self, link: list[int]):
        self.up, n = list(link), len(link)
        self.left, self.right, self.colour = [-1] * n, [-1] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            top, g = p, up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                top = g
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)
        self.colour[x] = self.colour[top]

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from ``x`` to the root; the (deepest node, colour) of each segment it fell into, from below."""
        up, right, colours = self.up, self.right, self.colour
        found, below = [], -1
        while x >= 0:
            self._splay(x)
            found.append((x, colours[x]))
            deeper = right[x]
            if deeper >= 0:
                colours[deeper] = colours[x]
            right[x] = below
            below = x
            x = up[x]
        colours[below] = colour
        return found


def _agrees(a: np.ndarray, at: int, period: int) -> int:
    """First position from ``at`` on where the word differs from the one a period before."""
    size = 64
    while at < len(a):
        differs = a[at : at + size] != a[at - period : at - period + len(a[at : at + size])]
        if differs.any():
            return at + int(differs.argmax())
        at += size
        size *= 2
    return len(a)


def stretch_runs(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence."""
    words, found = a.tolist(), []
    longest, link, ends = automaton(words)
    tree, until = AccessTree(link), {}
    n = len(words)
    for i, state in enumerate(ends):
        for node, last in tree.access(state, i):
            period = i - last
            if last < 0 or period > longest[node] or until.get(period, -1) >= i:
                continue
            end = i + 1
            if end < n and words[end] == words[end - period]:
                end = _agrees(a, end + 1, period)
            until[period] = end - 1
            start = i - 2 * period + 1
            if end - start >= max(MIN_WORDS, MIN_EXPONENT * period):
                found.append((start, end - start, period))
    return found


def text_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a whole text by start, then period."""
    found = []
    for start, end in stretches(words):
        found += [(s + start, n, p) for s, n, p in stretch_runs(words[start:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first in the order of ``runs``."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def find_runs(df: DataFrame, text_col: str = "text", out: str = "repeats") -> DataFrame:
    """Add ``out``: a struct of runs, best and collapsed (the text without repeated blocks)."""

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _Numbers()
        for texts in batches:
            runs, best, collapsed = [], [], []
            for text in texts.cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                if len(numbers) > MEMO_WORDS:
                    numbers.clear()
                found = text_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                top = best_run(found)
                best.append(top and dict(zip(("start", "length", "period"), top)))
                collapsed.append(collapse(words, found))
            columns = [pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(columns, ["runs", "best", "collapsed"])

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, arrow_udf(judge, _KIND).asNondeterministic()(df[text_col]))
