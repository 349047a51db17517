"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as case-folded letters and digits. An item of ``m`` such characters may occur in a
document with up to ``e = min(RATE * m, (m - Q) // Q)`` edits. An occurrence with ``e`` edits keeps at least
``m + 1 - Q - Q * e`` of the item's q-grams, all on diagonals (text position minus item position) at most ``e``
apart from its first. So shared q-grams are counted in overlapping diagonal bands of width ``2 * (e + 1)``, only bands that reach the bound stay,
and each of them is verified by banded alignment of the whole item; the filter itself loses nothing.

An item of more than ``WINDOW`` words is also searched by its windows of ``WINDOW`` words, ``STEP`` words apart and each with its own ``e``, so a quoted
part is found when it holds a whole window (always from ``WINDOW + STEP`` words on). A window counts where it overlaps no better occurrence of its item.
Items with fewer than ``MIN_CHARS`` characters are matched exactly, between word ends; scripts that don't separate words have one at each character.

The benchmark is taken in blocks of about ``BLOCK_CHARS`` characters by a hash of its rows, so what tasks receive is bounded at any
benchmark size; each block is searched in all documents, whole texts.

Results: null and empty texts have no hit. Null items and items without a letter or digit are left out. Repeated documents and repeated items each get their own rows. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import spare_name, text_udf

Q = 12
RATE = 0.06
MIN_CHARS = 24
WINDOW = 50
STEP = 25
BLOCK_CHARS = 2_000_000
_TABLE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {k: np.uint64(pow(int(_BASE), k, 1 << 64)) for k in (2, 4)}
#: Scripts written without blanks: Thai, Lao and Tibetan, Myanmar, Khmer, East Asian.
_UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xABFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_BLANK = np.array([not chr(c).isalnum() for c in range(1 << 16)])
_PLAIN = ~_BLANK[:256]

HITS = "array<struct<item: bigint, start: int, length: int, edits: int>>"


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the case-folded letters and digits, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when folded: fold those that don't
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    try:  # one byte a character where that holds the text
        points = np.frombuffer(low.encode("latin-1"), np.uint8)
        at = np.flatnonzero(_PLAIN[points])
    except UnicodeEncodeError:
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(~_BLANK[np.minimum(points, 0xFFFF)] | (points > 0xFFFF))
    return points[at].astype(np.uint32), at


def gram_hashes(points: np.ndarray) -> np.ndarray:
    m = len(points) - Q + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    # The polynomial over Q = 12 characters from those over 2, 4 and 8.
    h1 = points.astype(np.uint64)
    h2 = h1[:-1] * _BASE + h1[1:]
    h4 = h2[:-2] * _POWERS[2] + h2[2:]
    h8 = h4[:-4] * _POWERS[4] + h4[4:]
    h = h8[:m] * _POWERS[4] + h4[8 : 8 + m]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_breaks(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place from 0 to the length of the folded text, whether a word may start or end there."""
    out = np.ones(len(points) + 1, bool)
    unspaced = np.zeros(len(points), bool)
    for low, high in _UNSPACED:
        unspaced |= (points >= low) & (points <= high)
    out[1:-1] = (np.diff(at) > 1) | unspaced[1:] | unspaced[:-1]
    return out


def item_windows(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Folded windows of ``WINDOW`` words of an item with more words, the last one at its end."""
    ends = np.flatnonzero(word_breaks(points, at))
    last = len(ends) - 1 - WINDOW
    return [points[ends[k] : ends[k + WINDOW]] for k in sorted({*range(0, last, STEP), last})] if last > 0 else []


def edit_budget(m: int) -> int:
    return max(0, min(math.floor(RATE * m), (m - Q) // Q))


def gram_bound(m: int) -> int:
    return m + 1 - Q - Q * edit_budget(m)


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best occurrence of the whole item on diagonals ``low`` to ``high``: (edits, start, end) in the text, or None above the budget.

    Rows are item characters; a cell of the band is a diagonal. The start is free along the text, ties go to the leftmost end.
    """
    width, big = high - low + 1, 1 << 20
    slot = np.arange(width)
    place = low + slot  # text position before the first item character
    cost = np.where((place >= 0) & (place <= len(text)), 0, big)
    start = place.copy()
    for i, c in enumerate(item):
        at = place + i
        inside = (at >= 0) & (at < len(text))
        differs = np.where(inside, text[np.clip(at, 0, len(text) - 1)] != c, True)
        step = np.where(inside, cost + differs, big)
        deleted = np.append(cost[1:] + 1, big)  # the item's character is missing: one diagonal down
        take = deleted < step
        new, begun = np.where(take, deleted, step), np.where(take, np.append(start[1:], 0), start)
        new = np.where(at + 1 <= len(text), new, big)
        best = np.minimum.accumulate(new - slot) + slot  # extra text characters: along the row
        source = np.maximum.accumulate(np.where(new == best, slot, 0))
        cost, start = best, begun[source]
        if cost.min() > budget:
            return None
    end = place + len(item)
    cost = np.where(end <= len(text), cost, big)
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(end[k])) if cost[k] <= budget else None


class BenchmarkIndex:
    """Folded items of one block with the postings of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.items, self.source, self.short = [], [], [], {}
        for source, (i, text) in enumerate(items):
            points, at = fold(text)
            if len(points) >= MIN_CHARS:
                for part in [points, *(w for w in item_windows(points, at) if len(w) >= MIN_CHARS)]:
                    self.ids.append(i)
                    self.items.append(part)
                    self.source.append(source)
            elif len(points):
                self.short.setdefault(len(points), {}).setdefault(points.tobytes(), []).append(i)
        self.whole = np.append(True, np.diff(self.source) > 0)
        grams = [gram_hashes(p) for p in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - _TABLE_BITS)] = True
        self.budget = np.array([edit_budget(len(p)) for p in self.items], np.int64)
        self.bound = np.array([gram_bound(len(p)) for p in self.items], np.int64)

    def find(self, text: str | None) -> list[dict]:
        """Occurrences (item, start, length, edits) in one whole text; of overlapping ones of an item the best, then the first."""
        if not text or not (self.items or self.short):
            return []
        points, origin = fold(text)
        out = self.find_long(points, origin) + self.find_short(points, origin)
        return sorted(out, key=lambda r: (r["item"] is None, r["item"] or 0, r["start"]))

    def find_short(self, points: np.ndarray, origin: np.ndarray) -> list[dict]:
        """Exact occurrences of the items under ``MIN_CHARS``, between word ends; of overlapping ones of an item the first."""
        out = []
        if not self.short or not len(points):
            return out
        breaks = word_breaks(points, origin)
        raw = points.tobytes()
        for size, items in self.short.items():
            starts = np.flatnonzero(breaks[: max(0, len(breaks) - size)] & breaks[size:])
            # Only places whose first, middle and last character some item has.
            ends_of = np.array([np.frombuffer(k, np.uint32)[[0, size // 2, size - 1]] for k in items], np.int64)
            marks = (points[starts].astype(np.int64) << 42) | (points[starts + size // 2].astype(np.int64) << 21) | points[starts + size - 1]
            starts = starts[np.isin(marks, (ends_of[:, 0] << 42) | (ends_of[:, 1] << 21) | ends_of[:, 2])]
            ends: dict[bytes, int] = {}
            for s in starts.tolist():
                same = items.get(key := raw[4 * s : 4 * (s + size)])
                if same and s >= ends.get(key, 0):
                    ends[key] = s + size
                    start = int(origin[s])
                    out += [{"item": i, "start": start, "length": int(origin[s + size - 1]) + 1 - start, "edits": 0} for i in same]
        return out

    def find_long(self, points: np.ndarray, origin: np.ndarray) -> list[dict]:
        if not self.items:
            return []
        h = gram_hashes(points)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        n = self.count[k]
        post = np.repeat(self.first[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        owner, diagonal = self.owner[post], np.repeat(at, n) - self.place[post]
        half = self.budget[owner] + 1
        band = diagonal // half
        span = len(points) + (1 << 24)
        keys, counts = np.unique(np.concatenate([owner * span + band, owner * span + band - 1]) + (1 << 23), return_counts=True)
        enough = counts >= self.bound[keys // span]
        bands = [(key // span, key % span - (1 << 23)) for key in keys[enough].tolist()]

        def hit(item: int, b: int) -> tuple[int, int, int] | None:
            e, part = int(self.budget[item]), self.items[item]
            low, high = b * (e + 1), (b + 2) * (e + 1) - 1
            # A diagonal with all grams of the item is a verbatim occurrence: no alignment is better.
            mine = diagonal[(owner == item) & (diagonal >= low) & (diagonal <= high)]
            on, grams = np.unique(mine, return_counts=True)
            for d in on[grams == len(part) - Q + 1].tolist():
                if np.array_equal(points[d : d + len(part)], part):
                    return 0, d, d + len(part)
            return banded_alignment(part, points, low - e, high + e, e)

        out: list[dict] = []
        taken: dict[int, list[tuple[int, int]]] = {}

        def take(found: list[tuple[int, int, int, int]]) -> None:
            """Of overlapping occurrences of a benchmark item the best, then the first."""
            for edits, s, e, item in sorted(found):
                places = taken.setdefault(self.source[item], [])
                if all(e <= a or s >= b for a, b in places):
                    places.append((s, e))
                    start = int(origin[s])
                    out.append({"item": self.ids[item], "start": start, "length": int(origin[e - 1]) + 1 - start, "edits": edits})

        whole = [(*place, item) for item, b in bands if self.whole[item] and (place := hit(item, b))]
        take(whole)
        parts = []
        for item, b in bands:
            if self.whole[item]:
                continue
            e = int(self.budget[item])
            first, last = (b + 2) * (e + 1) - 1 + e, b * (e + 1) - e + len(self.items[item]) - e
            # Wherever in the band the window stands, it overlaps an occurrence of its whole item: it can't count.
            if any(first < stop and last > start for start, stop in taken.get(self.source[item], ())):
                continue
            if place := hit(item, b):
                parts.append((*place, item))
        take(parts)
        return out


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[BenchmarkIndex]:
    """Indexes of blocks of the benchmark, one at a time."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("id"), benchmark[text_col].alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about block_chars characters
        yield BenchmarkIndex(sorted(((r.id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def with_hits(docs: DataFrame, index: BenchmarkIndex, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the occurrences of the block's items in the text."""

    def make():
        return lambda texts: [[index.find(t) for t in texts]]

    return docs.withColumn(out, text_udf(f"hits {HITS}", make)(docs[text_col])["hits"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, item_id, start and length (code points of the text), edits."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    parts = []
    for index in benchmark_blocks(benchmark, item_id_col, item_text_col):
        hits = with_hits(rows, index, "text", "hits").select("doc_id", F.explode("hits").alias("h"))
        parts.append(hits.select("doc_id", F.col("h.item").alias("item_id"), "h.start", "h.length", "h.edits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any occurrence, with the input's columns."""
    out = docs
    for index in benchmark_blocks(benchmark, item_id_col, item_text_col):
        name = spare_name(docs.columns, "hits")
        out = with_hits(out, index, text_col, name).where(F.size(name) == 0).drop(name)
    return out
