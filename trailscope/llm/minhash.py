"""Near-duplicate detection by min-max hashing.

A document's set holds the hashes of its distinct 5-word shingles. Under each of ``PERMUTATIONS`` hash functions both the minimum and the
maximum are kept, which gives two unbiased signature values for one pass of hashing. Bands of ``band_rows(percent)`` values (a minimum and a
maximum of the same function are never in one band) put documents into buckets: a pair at the threshold shares none
with a probability below ``MISS`` (24 bands of 5 at 0.85, 30 of 4 at 0.80).

Equal sets collapse to one node (64 bits of the set's digest) before banding, so groups of exact copies cost one row and get their component by a join; ids
play no part in the search. In each bucket every member is
compared with the most connected one (the member with the largest buckets), not with all others: candidates grow with
the members. Links are confirmed on the full sets. Buckets whose members are then still in several components are searched once more, across
components only: pair by pair where that is at most ``CROSS`` pairs for each member (so always up to twice as many members, and with a few
stragglers beside a large component), otherwise by an exact prefix-filter join (``prefix_pairs``) over the members of all such buckets. So
each pair that shares a bucket is linked, excluded or in one component. Components come from alternating large-star and small-star steps on stored edges.

Results: null, empty and blank texts have an empty set and are linked with nothing. Fewer than five words make one shingle. Rows with
the same id count as one document in ``near_duplicates``: all their texts are in one component. ``drop_near_duplicates`` goes by texts alone: a row goes only if another kept row has an equal or linked
set. A null id is its own component (null) and kept. An empty table gives an
empty result. Texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import WORD, slices, spare_name, store

SHINGLE = 5
PERMUTATIONS = 60
MISS = 1e-6
CROSS = 6
PERCENT = 85
_COUNT_BITS = 18
_CHUNK = 4096

_rng = np.random.default_rng(85)
_MUL = _rng.integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64)
_FOLD = _rng.integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MEMO_WORDS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, memo: _Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles (A to Z lower-cased, words between ASCII blanks)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        whole = blake2b(b" ".join(words), digest_size=8, person=b"short").digest()
        return np.frombuffer(whole, np.uint64)
    m = len(h) - SHINGLE + 1
    return np.unique(_mix(sum(h[k : k + m] * _PLACE[k] for k in range(SHINGLE))))


def band_rows(percent: int) -> int:
    """The most values a band may have so that a pair at the threshold shares no band with a probability below ``MISS``."""
    for rows in range(PERMUTATIONS, 0, -1):
        if PERMUTATIONS % rows == 0 and (1 - (percent / 100) ** rows) ** (2 * PERMUTATIONS // rows) < MISS:
            return rows
    raise ValueError(f"{2 * PERMUTATIONS} signature values are too few for {percent} percent")


def band_keys(shingles: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band from the minima and maxima under all hash functions."""
    low, high = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        values = _MUL[:, None] * shingles[None, at : at + _CHUNK] + _ADD[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    bands = np.concatenate([low, high]).reshape(-1, rows)
    return _mix((_mix(bands) * _FOLD[:rows]).sum(axis=1) + np.arange(len(bands), dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, row, n_shingles, set_key, bands) of docs (id, row, text); set_key identifies equal sets, null bands for empty ones."""
    rows = band_rows(percent)

    def run(batches):
        memo = _Words()
        for batch in slices(batches):
            n, keys, bands = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, memo)
                n.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(s, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "row", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("id").cast("long"), "row", "text").mapInArrow(run, "id long, row long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles) with the sorted hashes of the whole set and its node; docs are (text)."""

    def run(batches):
        memo = _Words()
        for part in slices(batches):
            sets = [shingle_set(t, memo) for t in part.column("text").to_pylist()]
            keys = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(run, "set_key binary, shingles array<long>").select(F.xxhash64("set_key").alias("id"), "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


def _similar_sizes(x: str, y: str, percent: int) -> str:
    return f"100 * {x} >= {percent} * {y} AND 100 * {y} >= {percent} * {x}"


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each member and its bucket's most connected one; members are (key, id, n, degree)."""
    pivots = store(members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"), "n")).alias("top")), "near-pivots")
    pivots = pivots.select("key", (-F.col("top.neg")).alias("pivot"), F.col("top.n").alias("pn"))
    pairs = members.join(pivots, "key").where("id <> pivot").where(_similar_sizes("n", "pn", percent))
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of a bucket in different components; members are (key, id, n, label)."""
    other = members.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    pairs = members.join(other, "key").where("id < id2 AND label <> label2").where(_similar_sizes("n", "n2", percent))
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, label, pos, short) of the first shingles of each member's set, the rarest first; members are (id, n, label).

    Sets that are similar share a shingle among the first ``n - percent * n + 1`` of the larger and, with ``short``, the first
    ``n - 2 * percent / (100 + percent) * n + 1`` of the smaller one. This holds in any order common to all sets; shingles are
    counted by their first ``_COUNT_BITS`` bits, which bounds what the tasks receive.
    """
    rows = store(sets.join(members, "id"), "near-open-sets")
    counted = rows.select(F.explode("shingles").alias("s")).groupBy(F.shiftrightunsigned("s", 64 - _COUNT_BITS).alias("k")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    counts = np.zeros(1 << _COUNT_BITS, np.int64)
    counts[counted["k"].to_numpy()] = counted["c"].to_numpy()

    def run(batches):
        for part in slices(batches):
            columns = [[], [], [], [], [], []]
            for i, n, label, shingles in zip(*(part.column(c).to_pylist() for c in ("id", "n", "label")), part.column("shingles")):
                s = shingles.values.to_numpy().view(np.uint64)
                order = np.lexsort((s, counts[s >> np.uint64(64 - _COUNT_BITS)]))
                size = n - (percent * n + 99) // 100 + 1
                pos = np.arange(size)
                short = pos <= n - -(-2 * percent * n // (100 + percent))
                for c, v in zip(columns, (s[order[:size]].view(np.int64), np.full(size, i), np.full(size, n), np.full(size, label), pos, short)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["token", "id", "n", "label", "pos", "short"])

    return rows.select("id", "n", "label", "shingles").mapInArrow(run, "token long, id long, n long, label long, pos long, short boolean")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all members in different components that can be similar, by an exact prefix-filter join; members are (id, n, label).

    Under each shingle only members outside its largest component meet all others, so that component isn't paired with itself.
    """
    rows = store(prefixes(members, sets, percent), "near-prefixes")
    parts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.max("short").alias("short"))
    tokens = parts.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max("short").alias("any"), F.max(F.struct("c", "label"))["label"].alias("main")).where("parts > 1 AND any")
    rows = store(rows.join(store(tokens.select("token", "main"), "near-tokens"), "token").withColumn("rest", F.col("label") != F.col("main")).drop("main"), "near-token-rows")
    other = rows.select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "label", "pos", "rest")])

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        # All that two sets share comes at or after the first shared shingle.
        pairs = small.join(large, "token").where("label <> label2 AND n <= n2").where(_similar_sizes("n", "n2", percent))
        pairs = pairs.where(f"least(n - pos, n2 - pos2) * {100 + percent} >= {percent} * (n + n2)")
        return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()

    return met(rows.where("short AND rest"), other).unionByName(met(rows.where("short AND NOT rest"), other.where("rest2"))).distinct()


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """(id, label): smallest reachable id of every id in ``edges`` (a, b).

    Large-star: the larger neighbours of a node move to its smallest neighbour; small-star: the smaller
    ones and itself. Both only regroup edges, with the minimum as a partial aggregate.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that both sides of the join are plain exchanges and the edges of a hub can be split.
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), f"{name}-large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = store(small.where("u <> v").distinct(), f"{name}-small")
        before, state = state, tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _open_buckets(members: DataFrame, name: str) -> DataFrame:
    """Members (with label) of buckets that span several components, with ``few``: cross pairs are at most ``CROSS`` for each member."""
    parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    span = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same")).where("parts > 1")
    few = F.col("size") * F.col("size") - F.col("same") <= 2 * CROSS * F.col("size")
    return store(members.join(store(span.select("key", few.alias("few")), f"{name}-open"), "key"), f"{name}-left")


def near_links(docs: DataFrame, distinct: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between nodes; ``distinct`` has a row (id, n, bands, rep) per distinct set, docs are (id, text).

    ``rep`` is the id of some document with the set; the sets to confirm are computed again from the texts of these ids.
    """
    rows = distinct.select("id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    shared = store(rows.join(sizes, "key").select("key", "id", "n", "band", "size"), "near-shared")
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    members = store(shared.drop("size").join(degree, "id"), "near-members")
    first = store(star_pairs(members, percent), "near-pairs")
    # The ids grow with the corpus, so these are merge joins at every size. An id that stands for several texts brings sets that nobody asks for.
    wanted = store(distinct.select("id", "rep").join(members.select("id").distinct().hint("merge"), "id", "left_semi").select(F.col("rep").alias("id")).distinct(), "near-wanted")
    sets = store(full_sets(docs.join(wanted.hint("merge"), "id", "left_semi")).dropDuplicates(["id"]), "near-sets")
    links = store(confirm(first, sets, percent), "near-links")

    labelled = members.join(components(links), "id", "left").withColumn("label", F.coalesce("label", "id"))
    left = _open_buckets(store(labelled, "near-labelled"), "near")
    if left.isEmpty():
        return links
    pairs = cross_pairs(left.where("few"), percent)
    large = store(left.where("NOT few").select("id", "n", "label").distinct(), "near-large")
    if not large.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(large, sets, percent))
    pairs = store(pairs.distinct().join(first, ["a", "b"], "left_anti"), "near-more-pairs")
    return links.unionByName(store(confirm(pairs, sets, percent), "near-more-links"))


def _linked_sets(docs: DataFrame, signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, rep) of the distinct sets in ``signed`` and the links between them; docs are (id, text)."""
    linkable = signed.where("node IS NOT NULL")
    distinct = store(linkable.groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).withColumnRenamed("node", "id"), "near-distinct")
    return distinct.select("id", "rep"), near_links(docs.where("id IS NOT NULL"), distinct, percent)


def _signed(docs: DataFrame, percent: int) -> DataFrame:
    """Stored signatures with the node of each set: null for empty sets and null ids, which are linked with nothing."""
    node = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.xxhash64("set_key"))
    return store(signatures(docs, percent).withColumn("node", node), "near-signatures")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept (is the component's smallest id)."""
    docs = df.select(df[id_col].cast("long").alias("id"), F.lit(0).cast("long").alias("row"), df[text_col].alias("text"))
    signed = _signed(docs, percent)
    nodes, links = _linked_sets(docs, signed, percent)
    # An id may stand for several texts: they belong together.
    several = store(signed.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("id", "b"), "near-several")
    twins = signed.where("node IS NOT NULL").select("id", F.col("node").alias("a")).join(several, "id").where("a <> b").select("a", "b")
    labels = components(links.unionByName(twins), "near-all")
    placed = store(nodes.join(labels, "id", "left").select("id", "rep", F.coalesce("label", "id").alias("label")), "near-placed")
    smallest = store(placed.groupBy("label").agg(F.min("rep").alias("component_id")), "near-smallest")
    found = store(placed.join(smallest, "label").select(F.col("id").alias("node"), "component_id"), "near-found")
    out = signed.join(found, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component of equal or linked sets, with the input's columns: the one with the smallest id, then the smallest hash of its columns.

    Rows with an empty set or a null id are all kept.
    """
    key = spare_name(df.columns, "near_id")
    row = spare_name([*df.columns, key], "near_row")
    keyed = df.withColumns({key: df[id_col].cast("long"), row: F.xxhash64(*[df[c] for c in df.columns])})
    docs = keyed.select(F.col(key).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    signed = _signed(docs, percent)
    nodes, links = _linked_sets(docs, signed, percent)
    labels = store(nodes.join(components(links, "near-all"), "id", "left").select(F.col("id").alias("node"), F.coalesce("label", "id").alias("label")), "near-placed")
    rows = store(signed.where("node IS NOT NULL").select("id", "row", "node").join(labels, "node").select("id", "row", "label"), "near-rows")
    best = store(rows.groupBy("label").agg(F.min(F.struct("id", "row")).alias("best")), "near-best")
    gone = rows.join(best, "label").where(F.struct("id", "row") != F.col("best")).select(F.col("id").alias(key), F.col("row").alias(row)).distinct()
    # Rows with a set meet those to drop; equal ones are folded before the shuffle, which the join then shares.
    linkable = F.coalesce(F.col(key).isNotNull() & F.col(text_col).rlike(WORD), F.lit(False))
    once = keyed.where(linkable).dropDuplicates([key, row]).join(store(gone, "near-gone").hint("merge"), [key, row], "left_anti")
    return once.select(*df.columns).unionByName(keyed.where(~linkable).select(*df.columns))
