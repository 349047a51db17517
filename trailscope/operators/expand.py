"""Row replication that spreads hot rows over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 100_000
E = F.expr


def _num_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def replicate_rows(
    df: DataFrame, count: str, chunk_rows: int | None = None, index: str | None = None, spread_all: bool = False
) -> DataFrame:
    """Emit every row ``count`` times (``count`` is SQL text; rows with ``count <= 0`` vanish).
    With ``index``, a column of that name numbers the copies of each row from 1.

    Rows needing at most ``chunk_rows`` (:data:`DEFAULT_CHUNK_ROWS`) copies are expanded where they are, with
    no shuffle. A hot row (one session with a third of all orders, one group of
    identical rows) is first cut into chunk descriptors, which are hash-spread
    over the shuffle partitions by an explicit-count repartition (AQE does not
    coalesce it back into one task), and only then expanded. When no row is
    hot, Spark prunes that branch as an empty relation. With ``spread_all`` every row goes that way: one branch, for inputs that are costly to plan twice.
    """
    chunk_rows = chunk_rows or DEFAULT_CHUNK_ROWS
    cols = df.columns
    small_at, big_at = ([], []) if index is None else ([E(f"__i AS {index}")], [E(f"__c * {chunk_rows} + __i AS {index}")])
    tagged = df.withColumn("__n", E(f"CAST({count} AS BIGINT)"))
    small = (
        tagged.filter(f"__n >= 1 AND __n <= {chunk_rows}")
        .withColumn("__i", E("explode(sequence(CAST(1 AS BIGINT), __n))"))
        .select(*cols, *small_at)
    )
    chunks = tagged.filter("__n >= 1" if spread_all else f"__n > {chunk_rows}").withColumn(
        "__c", E(f"explode(sequence(CAST(0 AS BIGINT), CAST(floor((__n - 1) / {chunk_rows}) AS BIGINT)))")
    )
    row_hash = "xxhash64(" + ", ".join(f"`{c}`" for c in cols) + ")"
    spread = chunks.repartition(_num_tasks(df), E(row_hash), F.col("__c"))
    big = spread.withColumn(
        "__i", E(f"explode(sequence(CAST(1 AS BIGINT), least(CAST({chunk_rows} AS BIGINT), __n - __c * {chunk_rows})))")
    ).select(*cols, *big_at)
    return big if spread_all else small.unionByName(big)
