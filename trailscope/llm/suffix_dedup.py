"""Exact substring dedup over a prefix-free parse.

Every byte covered by a ``LENGTH``-byte string that starts at least twice in the corpus is removed.

*Parse.* A rolling hash over ``GRAM`` bytes marks a trigger wherever it is the minimum of some ``TRIGGER_WINDOW``
consecutive positions. The stretch from one trigger to the end of the next is a phrase; phrases overlap by the trigger, so
no phrase suffix longer than the trigger is a prefix of another. Two triggers fit any
``LENGTH`` bytes, and which ones only depends on those bytes, so equal strings hold equal phrases.

*Dictionary.* Phrases are counted over the corpus; a phrase that occurs once can't lie in a repeated string. What remains
are runs of repeated phrases (and the bytes that strings reach beyond them), few in all but highly repetitive text.

*Corpus order.* In the combined order of (phrase suffix, parse after it) two positions share ``LENGTH`` bytes exactly if they lie in one
run of equal strings of that length. Only these classes are needed, not ranks, and they are found in two steps. Every position has an
anchor, the minimum of the rolling hash over the next ``UNIT_WINDOW`` positions; positions with the same anchor form a unit, and equal units (with all bytes that their strings
cover) are classes of the dictionary: all strings of a unit that occurs twice are repeated. A unit that occurs once can still share strings with others, but only with
units whose text from the anchor on starts alike; of the units that share such a start, one of each class gives its positions one by one, which are then
grouped by their strings.

Keys of strings have 96 bits. All grouping is by key with partial sums, a hot key's rows are only joined
(adaptive execution splits them), and each step is stored, so lost executors cost one step.

Results: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; a repeated row (also with an equal id) is a
copy like any other; texts are cut at bytes, so ``kept`` is binary. An empty table gives an empty result. An input column named like the output is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trailscope.llm.common import discard, slices, spare_name, store

LENGTH = 200
GRAM = 16
TRIGGER_WINDOW = (LENGTH - GRAM + 1) // 2
UNIT_WINDOW = 48

_rng = np.random.default_rng(200)
_TABLES = [_rng.integers(1 << 63, size=256, dtype=np.uint64) for _ in range(2)]
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base ``k`` and of its inverse modulo 2^64, at least ``n`` of each."""
    if k not in _powers or len(_powers[k][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = int(_BASES[k])
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[k] = tuple(out)
    return _powers[k]


class Hashed:
    """Prefix hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, data: bytes, k: int = 0):
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        powers, self.inverse = _power(k, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLES[k][raw] * powers[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self) -> np.ndarray:
        m = self.n - GRAM + 1
        return _mix((self.sums[GRAM:] - self.sums[:m]) * self.inverse[:m])


def _window_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values the position of its leftmost minimum; at least ``w`` values."""
    n = len(v)
    packed = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[:n] = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[: n - w + 1], head[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Triggers of a text and the hashes of the phrases between neighbouring ones."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = Hashed(data)
    at = _window_argmin(h.grams(), TRIGGER_WINDOW)
    at = at[np.append(True, at[1:] != at[:-1])]
    return at, h.of(at[:-1], at[1:] + GRAM)


def runs(data: bytes, repeated: list[int]) -> list[tuple[int, int]]:
    """Stretches (start, end) that can hold repeated strings: runs of repeated phrases, widened by what a string can reach beyond them."""
    at, _ = parse(data)
    flag = np.zeros(len(at) + 1, bool)
    flag[1:][np.searchsorted(at, np.asarray(repeated, np.int64))] = True
    edge = np.flatnonzero(flag[1:] != flag[:-1])  # phrase numbers where a run begins or has ended
    if len(edge) % 2:
        edge = np.append(edge, len(at) - 1)
    begin, end = edge[::2], edge[1::2]
    # A string's first and last common trigger lie within TRIGGER_WINDOW positions of its ends.
    start = np.maximum(at[begin] - TRIGGER_WINDOW + 1, 0)
    stop = np.minimum(at[end] + LENGTH - TRIGGER_WINDOW, len(data))
    if not len(start):
        return []
    apart = np.append(True, start[1:] >= stop[:-1])  # runs that share a phrase between them are one stretch
    first = np.flatnonzero(apart)
    start, stop = start[first], stop[np.append(first[1:] - 1, len(stop) - 1)]
    keep = stop - start >= LENGTH
    return list(zip(start[keep].tolist(), stop[keep].tolist()))


def units(h: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last position and anchor of each unit of a stretch."""
    m = h.n - LENGTH + 1
    anchor = _window_argmin(h.grams()[: m + UNIT_WINDOW - 1], UNIT_WINDOW)
    lo = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return lo, np.append(lo[1:] - 1, m - 1), anchor[lo]


def covered_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, length) runs of bytes covered by strings whose starts are packed as ``lo << 32 | hi``."""
    if not len(spans):
        return []
    spans = np.unique(spans)
    lo, end = spans >> 32, (spans & 0xFFFFFFFF) + LENGTH
    end = np.maximum.accumulate(end)
    gap = np.flatnonzero(lo[1:] > end[:-1])
    first, last = lo[np.append(0, gap + 1)], end[np.append(gap, len(end) - 1)]
    return list(zip(first.tolist(), (last - first).tolist()))


def _emit(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from (rid, column arrays...) per text."""
    held, n = [], 0
    for rid, *columns in rows:
        held.append((np.full(len(columns[0]), rid, np.int64), *columns))
        n += len(columns[0])
        if n >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _keys(data: bytes, start: np.ndarray, end: np.ndarray, h: Hashed) -> tuple[np.ndarray, np.ndarray]:
    second = Hashed(data, 1).of(start, end)
    return h.of(start, end).view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column of longs as arrays (null: empty)."""
    for k in range(len(column)):
        row = column[k]
        yield row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int64)


def _by_text(batches, *names: str):
    for batch in slices(batches):
        yield from zip(*(_lists(batch.column(c)) if pa.types.is_list(batch.schema.field(c).type) else batch.column(c).to_pylist() for c in names))


def _parse_batches(batches):
    def rows():
        for rid, data in _by_text(batches, "rid", "data"):
            at, keys = parse(data)
            if len(keys):
                yield rid, at[:-1], keys.view(np.int64)

    yield from _emit(rows(), ["rid", "at", "k"])


def _stretch_batches(batches):
    for batch in batches:
        out = [(rid, s, data[s:e]) for rid, data, ats in _by_text([batch], "rid", "data", "ats") for s, e in runs(data, ats)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["rid", "start", "data"])


def _unit_batches(batches):
    def rows():
        for rid, start, data in _by_text(batches, "rid", "start", "data"):
            h = Hashed(data)
            lo, hi, anchor = units(h)
            near = h.of(anchor, anchor + LENGTH - UNIT_WINDOW).view(np.int64)
            yield rid, (lo + start) << 32 | (hi + start), *_keys(data, lo, hi + LENGTH, h), near

    yield from _emit(rows(), ["rid", "span", "k1", "k2", "near"])


def _position_batches(batches):
    """Positions of the listed units (packed as ``lo << 32 | hi << 1 | single``) that lie in the stretch."""

    def rows():
        for rid, start, data, listed in _by_text(batches, "rid", "start", "data", "listed"):
            lo, hi = (listed >> 32) - start, ((listed & 0xFFFFFFFF) >> 1) - start
            mine = (lo >= 0) & (hi + LENGTH <= len(data))
            if not mine.any():
                continue
            lo, n, single = lo[mine], (hi - lo + 1)[mine], (listed & 1)[mine].astype(bool)
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            yield rid, at + start, *_keys(data, at, at + LENGTH, Hashed(data)), np.repeat(single, n)

    yield from _emit(rows(), ["rid", "at", "k1", "k2", "single"])


def repeat_starts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(rid, spans): packed ranges of starts whose strings cover all repeated bytes; rid is xxhash64(text), one row per distinct text."""
    texts = df.select(F.xxhash64(df[text_col]).alias("rid"), F.encode(df[text_col], "utf-8").alias("data")).where(F.octet_length("data") >= LENGTH)
    # A text that several rows have is repeated as a whole.
    copies = texts.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("data")).alias("size")).where("n > 1")
    copies = store(copies.select("rid", F.array((F.col("size") - LENGTH).cast("long")).alias("spans")), "repeat-copies")
    phrases = store(texts.mapInArrow(_parse_batches, "rid long, at long, k long"), "repeat-parse")
    dictionary = store(phrases.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k"), "repeat-dictionary")
    marked = store(phrases.join(dictionary, "k").groupBy("rid").agg(F.collect_set("at").alias("ats")), "repeat-marked")
    discard(phrases, dictionary)
    # One row of each text goes on, folded before the shuffle that the join shares: its copies are done, and other texts need to meet it once only.
    stretches = store(texts.dropDuplicates(["rid"]).join(marked, "rid").mapInArrow(_stretch_batches, "rid long, start long, data binary"), "repeat-stretches")

    found = stretches.mapInArrow(_unit_batches, "rid long, span long, k1 long, k2 int, near long")
    # `first` of several columns comes from one row: none of them is null
    classes = store(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("near", "rid", "span")]), "repeat-classes")
    several = classes.where("c > 1").select("k1", "k2")
    whole = store(found.select("rid", "span", "k1", "k2").join(several, ["k1", "k2"]).groupBy("rid").agg(F.collect_list("span").alias("spans")), "repeat-whole")

    # Starts shared by two classes at least, one of them single.
    contested = store(classes.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).where("n > 1 AND least = 1").select("near"), "repeat-near")
    single = (F.col("c") == 1).cast("long")
    packed = F.shiftleft(F.shiftright("span", 32), 32).bitwiseOR(F.shiftleft(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)), 1)).bitwiseOR(single)
    listed = store(classes.join(contested, "near").groupBy("rid").agg(F.collect_list(packed).alias("listed")), "repeat-listed")
    positions = store(stretches.join(listed, "rid").mapInArrow(_position_batches, "rid long, at long, k1 long, k2 int, single boolean"), "repeat-positions")
    discard(stretches, classes, contested)
    twice = store(positions.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2"), "repeat-strings")
    at = F.shiftleft("at", 32).bitwiseOR(F.col("at"))
    fine = positions.where("single").join(twice, ["k1", "k2"]).groupBy("rid").agg(F.collect_list(at).alias("spans"))
    spans = store(whole.unionByName(fine).unionByName(copies).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeat-spans")
    discard(marked, whole, positions, twice)
    return spans


def remove_repeats(df: DataFrame, text_col: str = "text", out: str = "dedup") -> DataFrame:
    """Add ``out``: a struct of n_bytes, spans (start, length of each removed run, in bytes) and kept (the other bytes)."""
    rid, spans, key = (spare_name([*df.columns, out], x) for x in ("rid", "spans", "rid_found"))
    df = df.drop(out)
    found = repeat_starts(df, text_col).select(F.col("rid").alias(key), F.col("spans").alias(spans))

    @arrow_udf("struct<n_bytes: bigint, spans: array<struct<start: int, length: int>>, kept: binary>")
    def cut(data: pa.Array, starts: pa.Array) -> pa.Array:
        sizes, spans, kept = [], [], []
        for raw, packed in zip(data.to_pylist(), _lists(starts)):
            raw, mine = raw or b"", covered_spans(packed)
            pieces, last = [], 0
            for s, n in mine:
                pieces.append(raw[last:s])
                last = s + n
            sizes.append(len(raw))
            spans.append([{"start": s, "length": n} for s, n in mine])
            kept.append(b"".join([*pieces, raw[last:]]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["n_bytes", "spans", "kept"])

    keyed = df.withColumn(rid, F.xxhash64(df[text_col]))
    joined = keyed.join(found, F.col(rid) == F.col(key), "left")
    return joined.withColumn(out, cut(F.encode(F.col(text_col), "utf-8"), F.col(spans))).select(*df.columns, out)
