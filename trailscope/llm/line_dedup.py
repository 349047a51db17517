"""Incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII blanks at both ends and with A to Z lower-cased. A ``LineIndex`` counts, for each key, the documents that hold it
(rows: a repeated row is one more document), in a table of (shard, key, refs). Beside it stands a cuckoo filter per shard with the keys that have reached ``min_docs``
references. Inserting documents adds their counts, deleting documents takes them off again; only the keys that cross ``min_docs`` are put into or taken out of the filters. A
filter that gets too full is built anew from the table, twice as large; a fingerprint that finds no place goes to the filter's stash, so no key is ever missed.
Each update writes new tables and leaves the old index as it was: a deletion brings the dropped lines back, and an older index can still be used.

*Dropping.* The keys of documents are first tested against the filters, in rounds of shards whose filters take ``ROUND_BYTES`` at most, which are sent to the tasks; a round only reads the
row groups of its shards. The few that pass are joined with the reference table, which removes the filters' false hits, and the keys to drop go back to their texts.

Keys have 128 bits and are not compared byte by byte. Counts are partial sums before the shuffle, so a line of all documents is a row per task; the steps are stored, so joins can be split and lost executors cost a step.

Results: a null or empty text is one empty line. Keys shorter than ``min_chars`` code points are never dropped. Only the line feed ends a line; a carriage return is a blank. Kept lines stay as they are, joined by line
feeds. Texts that lose all lines become empty. An empty table gives an empty result. Deleting documents that were never inserted is an error. An input column named like the output is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh3_128_digest

from trailscope.llm.common import discard, spare_name, store

MIN_DOCS = 10
MIN_CHARS = 1
SHARDS = 256
ROUND_BYTES = 32 << 20
SLOTS = 4
KICKS = 400
FILL = 0.85
_BLANKS = b"\x20\t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).lower()


def _digest(key: bytes) -> tuple[int, int]:
    raw = xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class CuckooFilter:
    """Approximate set of 64-bit keys with deletion: 16-bit fingerprints in two candidate buckets of ``SLOTS``."""

    def __init__(self, table: np.ndarray, stash: list[int] | None = None):
        self.table, self.stash = table, list(stash or [])
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter that ``keys`` keys fill by half at most."""
        return cls(np.zeros((1 << max(2, int(2 * keys / SLOTS).bit_length()), SLOTS), np.uint16))

    @property
    def capacity(self) -> int:
        return int(self.table.size * FILL)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.view(np.uint64)
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        return print_, first, first ^ self._jump(print_)

    def _jump(self, print_):
        return ((np.asarray(print_).astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)).astype(np.int64) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        hit = (self.table[first] == print_[:, None]).any(axis=1) | (self.table[second] == print_[:, None]).any(axis=1)
        return hit | np.isin(keys, self.stash) if self.stash else hit

    def insert(self, keys: np.ndarray) -> None:
        table = self.table
        for key, print_, first, second in zip(keys.tolist(), *(c.tolist() for c in self._places(keys))):
            for bucket in (first, second):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = print_
                    break
            else:
                self._kick(key, print_, first)

    def _kick(self, key: int, print_: int, bucket: int) -> None:
        """Move fingerprints to their other buckets until one finds a place; the moves are undone if none does."""
        moved = []
        for k in range(KICKS):
            slot = k % SLOTS
            held = int(self.table[bucket, slot])
            self.table[bucket, slot] = print_
            moved.append((bucket, slot, held))
            print_, bucket = held, bucket ^ int(self._jump(held))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return
        for bucket, slot, held in reversed(moved):
            self.table[bucket, slot] = held
        self.stash.append(key)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for key, print_, first, second in zip(keys.tolist(), *(c.tolist() for c in self._places(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in (first, second):
                held = np.flatnonzero(self.table[bucket] == print_)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


_FILTER = "shard int, cells binary, stash array<long>, keys long"


def _filter_of(row) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(row["cells"], np.uint16).reshape(-1, SLOTS).copy(), row["stash"])


@dataclass(frozen=True)
class LineIndex:
    """Reference counts (shard, k1, k2, refs) and a filter per shard of the keys with ``min_docs`` references or more."""

    refs: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS

    def common(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_docs)


def empty_index(spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineIndex:
    """An index of no documents; choose ``shards`` so that one has some millions of common keys at most."""
    refs = spark.createDataFrame([], "shard int, k1 long, k2 long, refs long")
    return LineIndex(refs, spark.createDataFrame([], _FILTER), min_docs, min_chars, shards)


def _shard_of(k1: str, shards: int):
    """Shards are ranges of k1, in its order, so that files sorted by k1 are sorted by shard."""
    return F.expr(f"CAST((shiftright({k1}, 40) + {1 << 23}) * {shards} div {1 << 24} AS INT)")


def _first_key(shard: int, shards: int) -> int:
    """The smallest k1 of a shard."""
    return (-(-shard * (1 << 24) // shards) - (1 << 23)) << 40


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """(rid, k1, k2) of each row's distinct keys; rid names the text."""

    def run(batches):
        for batch in batches:
            at, first, second = [], [], []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.large_binary())):
                keys = {line_key(line) for line in (text.as_py() or b"").split(b"\n")}
                for key in keys:
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars):
                        k1, k2 = _digest(key)
                        at.append(rid)
                        first.append(k1)
                        second.append(k2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (at, first, second)], ["rid", "k1", "k2"])

    named = docs.select(F.xxhash64(docs[text_col]).alias("rid"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    return named.mapInArrow(run, "rid long, k1 long, k2 long")


def _update(index: LineIndex, docs: DataFrame, sign: int, text_col: str) -> tuple[LineIndex, DataFrame]:
    keys = store(line_keys(docs, index.min_chars, text_col).sortWithinPartitions("k1"), "lines-keys")
    changes = keys.groupBy("k1", "k2").agg(F.count(F.lit(sign)).alias("n")).select("k1", "k2", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("new"))
    known = index.refs.select("k1", "k2", F.col("refs").alias("old"), F.lit(0).cast("long").alias("new"))
    total = known.unionByName(changes).groupBy("k1", "k2").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    now = F.col("old") + F.col("new")
    now = F.when(now >= 0, now).otherwise(F.raise_error(F.lit("documents to delete were not in the index")).cast("long"))
    counted = total.select(_shard_of("k1", index.shards).alias("shard"), "k1", "k2", "old", now.alias("refs"))
    counted = store(counted.sortWithinPartitions("k1"), "lines-counted")
    refs = counted.where("refs > 0").select("shard", "k1", "k2", "refs")
    was, is_ = F.col("old") >= index.min_docs, F.col("refs") >= index.min_docs
    # A filter without room for its shard's keys is built anew from all of them.
    room = F.octet_length("cells") / 2 * FILL
    size = counted.where(is_).groupBy("shard").agg(F.count(F.lit(1)).alias("keys"))
    sizes = size.join(index.filters.select("shard", room.alias("room")), "shard", "left").select("shard", "keys", (F.col("keys") > F.coalesce("room", F.lit(0.0))).alias("anew"))
    sizes = store(sizes, "lines-sizes")
    marked = counted.where(was | is_).join(sizes, "shard", "left").withColumn("anew", F.coalesce("anew", F.lit(False)))
    marked = marked.where((was != is_) | (F.col("anew") & is_)).select("shard", "k2", is_.alias("stays"), "anew", F.coalesce("keys", F.lit(0)).alias("keys"))
    filters = index.filters.groupBy("shard").cogroup(store(marked, "lines-marked").groupBy("shard")).applyInArrow(_rebuild, _FILTER)
    return replace(index, refs=refs, filters=store(filters, "lines-filters")), keys


def _rebuild(held: pa.Table, marked: pa.Table) -> pa.Table:
    """One shard's filter after its changes: bounded by the shard's common keys."""
    shard = (held if held.num_rows else marked).column("shard")[0].as_py()
    row = held.to_pylist()[0] if held.num_rows else None
    keys = row["keys"] if row else 0
    if marked.num_rows:
        k2 = marked.column("k2").to_numpy()
        stays = marked.column("stays").to_numpy(zero_copy_only=False)
        keys = marked.column("keys")[0].as_py()
        if marked.column("anew")[0].as_py():
            found = CuckooFilter.sized(keys)
        else:
            found = _filter_of(row)
            found.delete(k2[~stays])
        found.insert(k2[stays])
    else:
        found = _filter_of(row)
    kind = pa.schema([("shard", pa.int32()), ("cells", pa.binary()), ("stash", pa.list_(pa.int64())), ("keys", pa.int64())])
    return pa.Table.from_pylist([{"shard": shard, "cells": found.table.tobytes(), "stash": found.stash, "keys": keys}], kind)


def insert_documents(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    return _update(index, docs, 1, text_col)[0]


def delete_documents(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    return _update(index, docs, -1, text_col)[0]


def _rounds(index: LineIndex) -> list[tuple[int, int]]:
    """Ranges of shards whose filters take about ``ROUND_BYTES``; one row per shard reaches the driver."""
    sizes = index.filters.select("shard", (F.octet_length("cells") + 8 * F.size("stash")).alias("bytes")).orderBy("shard").collect()
    out, total = [], 0
    for row in sizes:
        if not out or total + row["bytes"] > ROUND_BYTES:
            out.append((row["shard"], row["shard"]))
            total = 0
        out[-1] = (out[-1][0], row["shard"])
        total += row["bytes"]
    return out


def likely_common(keys: DataFrame, index: LineIndex) -> DataFrame:
    """The distinct rows (rid, k1, k2) of ``keys`` that pass the filters."""
    found = None
    for first, last in _rounds(index):
        filters = {r["shard"]: r.asDict() for r in index.filters.where(F.col("shard").between(first, last)).collect()}  # ROUND_BYTES at most, or one shard

        def probe(batches, filters=filters):
            ready = {shard: _filter_of(row) for shard, row in filters.items()}
            for batch in batches:
                shards, k2 = batch.column("shard").to_numpy(), batch.column("k2").to_numpy()
                hit = np.zeros(len(k2), bool)
                order = np.argsort(shards, kind="stable")
                cuts = np.flatnonzero(np.diff(shards[order])) + 1
                for rows in np.split(order, cuts):
                    if len(rows) and shards[rows[0]] in ready:
                        hit[rows] = ready[shards[rows[0]]].contains(k2[rows])
                yield batch.select(["rid", "k1", "k2"]).filter(pa.array(hit))

        # the bounds of k1 are pushed down to the sorted files
        mine = keys.where(F.col("k1").between(_first_key(first, index.shards), _first_key(last + 1, index.shards) - 1))
        mine = mine.select("rid", "k1", "k2", _shard_of("k1", index.shards).alias("shard"))
        part = mine.mapInArrow(probe, "rid long, k1 long, k2 long")
        found = part if found is None else found.unionByName(part)
    return keys.limit(0) if found is None else found


def drop_common_lines(df: DataFrame, index: LineIndex, text_col: str = "text", out: str = "lines", keys: DataFrame | None = None) -> DataFrame:
    """Add ``out``: a struct of n_lines, n_dropped and kept (the text without common lines); ``keys`` are the stored line keys of ``df``, if known."""
    rid, gone, key = (spare_name([*df.columns, out], x) for x in ("rid", "gone", "rid_found"))
    if keys is None:
        keys = store(line_keys(df, index.min_chars, text_col).sortWithinPartitions("k1"), "lines-keys")
    hits = store(likely_common(keys, index), "lines-hits")
    exact = hits.join(index.common().select("k1", "k2"), ["k1", "k2"], "left_semi")
    raw = F.struct("k1", "k2")
    dropped = store(exact.groupBy("rid").agg(F.collect_set(raw).alias("gone")), "lines-dropped")
    discard(hits)

    @arrow_udf("struct<n_lines: bigint, n_dropped: bigint, kept: string>")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        n_lines, n_dropped, kept = [], [], []
        for text, keys in zip(texts.cast(pa.large_binary()), gone):
            text = text.as_py() or b""
            if keys.is_valid:
                lines, drop = text.split(b"\n"), {(k["k1"], k["k2"]) for k in keys.as_py()}
                stay = [line for line in lines if _digest(line_key(line)) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            else:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(text)
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept"])

    keyed = df.withColumn(rid, F.xxhash64(df[text_col]))
    # The texts with lines to drop grow with the corpus, so this is a merge join at every size.
    lost = dropped.select(F.col("rid").alias(key), F.col("gone").alias(gone)).hint("merge")
    joined = keyed.join(lost, F.col(rid) == F.col(key), "left")
    return joined.withColumn(out, cut(F.col(text_col), F.col(gone))).select(*[c for c in df.columns if c != out], out)


def dedup_lines(df: DataFrame, text_col: str = "text", out: str = "lines", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` judged by an index of its own documents."""
    index, keys = _update(empty_index(df.sparkSession, min_docs, min_chars), df, 1, text_col)
    return drop_common_lines(df, index, text_col, out, keys)
