"""Sharding by sampled splitters, law ``bytes``: shard sizes near equal.

Records are ordered by (hash of the text, hash of the id), so equal texts are neighbours. A bounded
sample, drawn with probability by size (each record races with ``-log(u) / size``; the smallest win), gives
quantile boundaries of ``ranges_per_shard`` ranges for each shard. Records are range-partitioned by them, each range is
counted, and a range is cut by running size into pieces of at most one target each, so an overfull one is
subdivided. The pieces (a bounded table) are dealt to shards, largest first, each to the emptiest shard; slots follow
from piece offsets. A large group of equal texts splits over ranges by the id; a record larger than a range is a piece of its own.

Results: size is the UTF-8 bytes of the text (null: none) plus ``overhead``. Repeated rows are separate
records; ties in the order are between interchangeable records. An empty table gives an empty result. Input columns named
like the outputs are replaced.
"""

from __future__ import annotations

import bisect
import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailscope.llm.common import sha_order, small_table, spare_name, store

#: Fixed by the contract.
SHARDS = 40
OVERHEAD = 16
RANGES_PER_SHARD = 25
#: A range holds about so many bytes at most: with more data there are more ranges, not larger ones.
RANGE_BYTES = 256 << 20
SAMPLES_PER_RANGE = 8


def record_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def choose_splitters(keys: DataFrame, ranges: int, samples_per_range: int = SAMPLES_PER_RANGE) -> list[int]:
    """Boundaries (as one 128-bit number each) at quantiles of a sample weighted by size; ``keys`` has a, b, size.

    The race needs one pass and keeps ``ranges * samples_per_range`` narrow rows, the only ones that reach the driver.
    """
    u = (F.pmod(F.xxhash64("a", "b", F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = keys.select("a", "b", (-F.log(u) / F.col("size")).alias("t")).orderBy("t", "a", "b").limit(ranges * samples_per_range).collect()
    points = sorted(_joined(r.a, r.b) for r in drawn)
    return sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else []


def _joined(a: int, b: int) -> int:
    return (a + (1 << 63)) << 64 | (b + (1 << 63))


def range_of(splitters: list[int]):
    """An Arrow UDF (a, b) -> number of splitters at or below the key.

    Taken as nondeterministic, so that a filter the optimizer infers on its result (not null, from the join) doesn't run it
    a second time in the same task: that took a second Python worker for each core.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def find(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(splitters, _joined(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return find.asNondeterministic()


def pack(pieces: list[tuple[int, int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Deal (range, piece, bytes, rows, first) to shards; returns (range, piece, shard, shift) with slot = rank + shift."""
    heap = [(0, s) for s in range(shards)]
    own: dict[int, list] = {s: [] for s in range(shards)}
    for p in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        load, s = heapq.heappop(heap)
        own[s].append(p)
        heapq.heappush(heap, (load + p[2], s))
    out = []
    for s, mine in own.items():
        at = 0
        for r, c, _, rows, first in sorted(mine):
            out.append((r, c, s, at - first))
            at += rows
    return out


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, overhead: int = OVERHEAD, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Every input row with its columns, its shard (0 to ``shards`` - 1) and its slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = df.drop(shard_col, slot_col)
    a, b, z, r, rank, run, piece, shift = (spare_name([*df.columns, shard_col, slot_col], f"shard_{x}") for x in "a b size range rank run piece shift".split())
    keyed = df.withColumns({a: F.xxhash64(df[text_col]), b: sha_order(df[id_col]), z: record_size(df[text_col], overhead)})
    keys = store(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(z).alias("size")), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(shards * ranges_per_shard, math.ceil(total / RANGE_BYTES))
    limit = max(1, math.ceil(total / ranges))
    find = range_of(choose_splitters(keys, ranges))

    def placed(rows: DataFrame, a: str, b: str, z: str, r: str, rank: str, run: str, piece: str) -> DataFrame:
        # Rows equal in (a, b) have equal text and id, so they have equal size and may swap ranks.
        w = Window.partitionBy(r).orderBy(a, b).rowsBetween(Window.unboundedPreceding, 0)
        ranked = rows.withColumn(r, find(a, b)).withColumns({rank: F.row_number().over(Window.partitionBy(r).orderBy(a, b)), run: F.sum(z).over(w)})
        return ranked.withColumn(piece, F.floor((F.col(run) - F.col(z)) / F.lit(limit)))

    counted = placed(keys, "a", "b", "size", "r", "rank", "run", "piece").groupBy("r", "piece").agg(F.sum("size"), F.count(F.lit(1)), F.min("rank")).collect()  # at most two pieces per range on average
    table = small_table(spark, pack([tuple(x) for x in counted], shards) or [(0, 0, 0, 0)], f"`{r}` int, `{piece}` long, `{shard_col}` int, `{shift}` long")
    rows = placed(keyed, a, b, z, r, rank, run, piece).join(F.broadcast(table), [r, piece])
    return rows.withColumn(slot_col, (F.col(rank) + F.col(shift)).cast("long")).select(*df.columns, shard_col, slot_col)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write one folder per shard, rows in slot order within files."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.mode("overwrite").partitionBy(shard_col).parquet(path)
