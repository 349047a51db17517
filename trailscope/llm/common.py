"""Helpers shared by the corpus operators: stored steps, names, text columns."""

from __future__ import annotations

import atexit
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from trailscope.session import shared_path

#: A word: a run of characters other than the six ASCII blanks (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch that are turned into Python objects at once: bounds a worker's memory with long texts.
SLICE_ROWS = 128
SLICE_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before the interpreter: nothing left to ask
            return


atexit.register(_drop_written)


def step_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when the interpreter ends."""
    path = shared_path(spark, f"corpus/{name}")
    _written.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing the
    steps before), keeps results that several later steps read, and lets both sides of a
    join start from a plain exchange, which adaptive execution can split.
    """
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    release(spark)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.step_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete the files of steps that no unfinished result reads any more; large operators bound their disk by it."""
    for df in stored:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(df.step_path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps: it acts when the driver's JVM collects garbage."""
    try:
        context = spark.sparkContext
    except Exception:  # Spark Connect has no context here; the server cleans by its own interval
        return
    context._jvm.System.gc()


def spare_name(taken: list[str], base: str) -> str:
    """``base``, or the first numbered variant that no column has (names compare without case)."""
    low = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in low:
        n += 1
        name = f"{base}_{n}"
    return name


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; user columns can't clash afterwards."""
    return df.select(*[df[old].alias(new) for new, old in names.items()])


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, as a local relation: given as Arrow, they need no Python worker on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def text_udf(schema: str, make: Callable[[], Callable[[list], list[list]]]):
    """An Arrow UDF from a text column to a struct column.

    ``make`` runs once per task and returns a function from a list of texts (None
    for null) to one list per field of ``schema``. The optimizer takes the UDF as
    nondeterministic, so a filter or a generator on its result does not compute it twice.
    """
    kind = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    from collections.abc import Iterator

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for texts in batches:
            columns = [[] for _ in arrow]
            for few in _parts(texts, len(texts)):  # Python strings of a few rows at a time
                for column, part in zip(columns, work(few.to_pylist())):
                    column.extend(part)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], fields=list(arrow))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, kind).asNondeterministic()


def _parts(data, rows: int):
    """Slices of an Arrow array or batch, of ``SLICE_ROWS`` rows and ``SLICE_BYTES`` bytes at most, or of one row."""
    at = 0
    while at < rows:
        n = min(SLICE_ROWS, rows - at)
        while n > 1 and data.slice(at, n).nbytes > SLICE_BYTES:
            n //= 2
        yield data.slice(at, n)
        at += n


def slices(batches):
    """The rows of Arrow batches, a few at a time; what earlier batches took is given back to the system."""
    for batch in batches:
        yield from _parts(batch, batch.num_rows)
        pa.default_memory_pool().release_unused()


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo ``parts``, is ``fold`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == fold, F.lit(False))


def sha_order(*cols: Column) -> Column:
    """A reproducible pseudo-random order of rows by their columns."""
    return F.xxhash64(*cols)
