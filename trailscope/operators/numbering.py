"""Row numbers over a whole table without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES
from trailscope.operators.expand import replicate_rows
from trailscope.operators.quality import count_copies
from trailscope.session import remove_at_exit, shared_path

E = F.expr


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` as a BIGINT column ``out``.

    Equal rows are folded first (map-side) and expanded last. The distinct rows are sorted by range: rows that tie on ``order`` are
    ordered by a hash of all their columns, so a value that a third of the rows share is spread over many ranges as well. The sorted rows are stored below
    the shared folder, since a sort that is run again may be cut at other places; then the rows of each range are summed, and a row's number is
    the sum of the ranges before plus its place in its own range. One row per range reaches the driver.
    """
    if out in df.columns:
        raise ValueError(f"column {out} is taken")
    spark, columns = df.sparkSession, df.columns
    quoted = ", ".join("`" + c.replace("`", "``") + "`" for c in columns)
    ranges = count_copies(df).orderBy(*order, E(f"xxhash64({quoted})")).withColumn("__at", F.monotonically_increasing_id())
    path = remove_at_exit(spark, shared_path(spark, "numbered"))
    ranges.write.parquet(path)
    stored = spark.read.schema(ranges.schema).parquet(path).withColumn("__range", E("shiftright(__at, 33)"))

    sizes = stored.groupBy("__range").agg(E(f"sum({COPIES}) AS n")).orderBy("__range").collect()  # one row per range
    before, total = [], 0
    for row in sizes:
        before.append((row["__range"], total))
        total += row["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "__range long, __before long"))  # as above
    first = f"__before + sum({COPIES}) OVER (PARTITION BY __range ORDER BY __at ROWS UNBOUNDED PRECEDING) - {COPIES}"
    placed = stored.join(offsets, "__range").select(*columns, COPIES, E(f"{first} AS __first"))
    return replicate_rows(placed, COPIES, index="__copy").select(*columns, E(f"__first + __copy AS {out}"))
