"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are words. Sources get target word totals by weight, no target above
``max_repeat`` times the source (the excess is shared again among the others). A document of a source with ratio
``target / size = whole + part`` is taken ``whole`` times, and once more with inclusion
probability ``part``. Which documents get the extra copy is decided by the cube method: three
undecided documents at a time move along the one direction in which neither the expected words nor
the expected number of documents changes, until one of them is decided. The moves run as a stream over blocks of
a source (three documents in memory), largest documents first. Each block leaves at most
two undecided documents; those form the blocks of the next level, until one block per source remains,
whose last two are rounded, documents of that block being swapped while the word total comes nearer (landing). That block has at most
``BLOCK_ROWS`` documents.

Results: null texts have size 0; a null source is a source of its own, last in order. Rows equal in
id, source and text are decided together. Sources without words get target 0. Random numbers come from a fixed seed and the row order
from hashes, so reruns agree. An empty table gives an empty result. Only per-source totals (a row per source) reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import WORD, sha_order, small_table, spare_name, store

#: Fixed by the contract: weights by source order, repeating, and the largest repeat.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_ROWS = 4096
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> dict[str | None, float]:
    """Target words by source; the targets sum to the sizes' sum."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    open_, target = set(size), {}
    while open_:
        left = sum(size.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] > max_repeat * size[s] * total}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(max_repeat * size[s]) for s in above}
        open_ -= above
    return target


def _step(units: list[list], draw: float) -> None:
    """Move two or three undecided units [size, p, ...] so that at least one is decided and both totals keep."""
    if len(units) == 3:
        (a, b, c) = (u[0] for u in units)
        move = [b - c, c - a, a - b]
        if not any(move):
            move = [1, -1, 0]
    else:
        move = [1, -1]  # equal sizes only
    up, down = float("inf"), float("inf")
    for u, m in zip(units, move):
        if m:
            grow, shrink = (1 - u[1]) / abs(m), u[1] / abs(m)
            up, down = (min(up, grow), min(down, shrink)) if m > 0 else (min(up, shrink), min(down, grow))
    by = up if draw * (up + down) < down else -down
    for u, m in zip(units, move):
        u[1] += by * m
        u[1] = 0.0 if u[1] < _EPS else 1.0 if u[1] > 1 - _EPS else u[1]


def _land(held: list[list], decided: list[list], want: float) -> list[list]:
    """Round the last undecided units, and flip decided ones of the same block while that brings the word total nearer to ``want``.

    Each round changes the one unit that leaves the smallest difference (ties: the first), so a
    large document that stayed undecided is made up for by others.
    """
    for u in held:
        u[1] = float(u[1] >= 0.5)
    units = decided + held
    off = want - sum(u[0] * u[1] for u in units)
    for _ in range(len(units)):
        best = min(units, key=lambda u: abs(off - u[0] * (1 - 2 * u[1])), default=None)
        if best is None or abs(off - best[0] * (1 - 2 * best[1])) >= abs(off):
            break
        off -= best[0] * (1 - 2 * best[1])
        best[1] = 1 - best[1]
    return units


def flight(rows: Iterator[tuple[int, float, object]], seed: int, land: bool) -> Iterator[tuple[object, float]]:
    """Run the cube method over a stream of (size, probability, key); yields (key, probability), decided ones as 0 or 1."""
    import random

    rng = random.Random(seed)
    held: list[list] = []
    decided: list[list] = []
    want = 0.0

    def settle() -> Iterator[tuple[object, float]]:
        nonlocal held
        for u in held:
            if u[1] in (0.0, 1.0):
                if land:
                    decided.append(u)
                else:
                    yield u[2], u[1]
        held = [u for u in held if 0 < u[1] < 1]

    for size, p, key in rows:
        want += size * p
        held.append([size, p, key])
        yield from settle()
        while len(held) == 3 or (len(held) == 2 and held[0][0] == held[1][0]):
            _step(held, rng.random())
            yield from settle()
    if land:
        held = _land(held, decided, want)
    for u in held:
        yield u[2], u[1]


def _level(units: DataFrame, level: int) -> DataFrame:
    """One flight over all undecided units; ``blocks`` is the number of blocks of the unit's source."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("source", "block", "blocks", "words", "p", "id_hash", "k")))

        from itertools import groupby

        out: list[tuple] = []
        for (source, block, blocks), group in groupby(rows(), key=lambda r: r[:3]):
            seed = zlib.crc32(f"{level}\0{block}\0{source}".encode())
            for (h, k), p in flight(((r[3], r[4], (r[5], r[6])) for r in group), seed, blocks == 1):
                out.append((h, k, p))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["id_hash", "k", "p"])

    dealt = units.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("words"), "id_hash", "k")
    return dealt.select("source", "block", "blocks", "words", "p", "id_hash", "k").mapInArrow(run, "id_hash long, k long, p double")


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Decide copies for ``rows`` (source, size, id_hash, k, see :func:`mix_sources`), returns them with source_size, target and copies."""
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # a row per source
    targets = share_targets([(r.source, r.source_size) for r in totals], weights, max_repeat)
    table = [(r.source, r.source_size, targets[r.source], *_ratio(targets[r.source], r.source_size, max_repeat)) for r in totals]
    sources = small_table(spark, table, "source string, source_size long, target double, whole int, part double")
    units = (
        rows.groupBy("source", "id_hash", "k").agg(F.sum("size").alias("words"))
        .join(sources.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
        .where("part > 0").select("source", "id_hash", "k", "words", F.col("part").alias("p"))
    )
    decided, level = None, 0
    undecided = store(units, "mix-units")
    while not undecided.isEmpty():
        counts = undecided.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        dealt = undecided.join(counts.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id_hash", "k", F.lit(level)), "blocks"))
        moved = store(_level(dealt, level), "mix-level")
        done = moved.where("p IN (0.0, 1.0)")
        decided = done if decided is None else decided.unionByName(done)
        undecided = store(undecided.drop("p").join(moved.where("p NOT IN (0.0, 1.0)"), ["id_hash", "k"]), "mix-left")
        level += 1
    out = rows.join(sources.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    if decided is None:
        return out.withColumn("copies", F.col("whole").cast("int")).drop("whole", "part")
    extra = decided.where("p = 1.0").select("id_hash", "k", F.lit(1).alias("extra"))
    out = out.join(extra, ["id_hash", "k"], "left")
    return out.withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")).drop("whole", "part", "extra")


def _ratio(target: float, size: int, max_repeat: int) -> tuple[int, float]:
    ratio = min(target / size, float(max_repeat)) if size else 0.0
    whole = int(ratio + _EPS)
    part = ratio - whole
    return whole, part if part > _EPS else 0.0


def _keyed(df: DataFrame, id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    return {"id_hash": sha_order(df[id_col]), "k": F.xxhash64(df[id_col], df[source_col], df[text_col], F.lit(1))}


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, copies, taken."""
    rows = df.select(df[id_col].alias("doc_id"), df[source_col].cast("string").alias("source"), word_count(df[text_col]).alias("size"), *(c.alias(n) for n, c in _keyed(df, id_col, source_col, text_col).items()))
    mixed = plan_mix(store(rows, "mix-rows"), weights, max_repeat)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The input's rows with the input's columns, each as often as the mix takes it."""
    keys = _keyed(df, id_col, source_col, text_col)
    rows = df.select(df[source_col].cast("string").alias("source"), word_count(df[text_col]).alias("size"), *(c.alias(n) for n, c in keys.items()))
    plan = plan_mix(store(rows, "mix-rows"), weights, max_repeat).where("copies > 0").groupBy("id_hash", "k").agg(F.first("copies").alias("copies"))
    h, k, n = (spare_name(df.columns, x) for x in ("id_hash", "k", "copies"))
    keyed = df.withColumns({h: keys["id_hash"], k: keys["k"]})
    plan = plan.select(F.col("id_hash").alias(h), F.col("k").alias(k), F.col("copies").alias(n))
    copies = keyed.join(plan, [h, k]).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return copies.select(*df.columns)
