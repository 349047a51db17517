"""Loading the three tables: from the driver data or from stored tables."""

from __future__ import annotations

import hashlib
import threading
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailscope.functions.params import PARTITION_COLUMN, PARTITION_SQL, WebTables
from trailscope.operators.quality import count_copies, fill_nulls
from trailscope.operators.rollup import order_rollup
from trailscope.session import application_id, file_version, remove_at_exit, remove_path, shared_path
from trailscope.sources.csv_io import read_csv
from trailscope.sources.events import derive_web_tables
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_raw_tables(spark: SparkSession, sf_dir: str) -> WebTables:
    """Sessions, page views and orders derived from ``events`` (nulls not filled)."""
    return derive_web_tables(read_table(spark, sf_dir, "events"))


def load_tables(spark: SparkSession, sf_dir: str, clean: bool = True) -> WebTables:
    """The tables the reports run on: derived, then null-filled like the notebook."""
    raw = load_raw_tables(spark, sf_dir)
    return raw._replace(sessions=fill_nulls(raw.sessions)) if clean else raw


def read_csv_tables(spark: SparkSession, sessions: str, pageviews: str, orders: str, infer: bool = False) -> WebTables:
    """The raw CSV exports of the site, with pandas NA tokens read as NULL; ``infer`` also types the columns outside the schemas."""
    return WebTables(
        read_csv(spark, sessions, SESSIONS, infer=infer),
        read_csv(spark, pageviews, PAGEVIEWS, infer=infer),
        read_csv(spark, orders, ORDERS, infer=infer),
    )


# Materialized tables, one set per (application, session, data folder, data version, bucket count, variant).
_FRAMES: dict[tuple, WebTables] = {}
_LOCK = threading.Lock()


def write_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    buckets: int,
    key: str = "website_session_id",
    sort_by: tuple[str, ...] = (),
    shuffle: bool = True,
) -> None:
    """Store ``df`` as a table bucketed by ``key`` (one file per bucket).

    Only for tables where ``key`` is unique but for a few rows (counted sessions, facts per session): a bucket then never
    holds more than its share of rows. The repartition uses the same hash as
    bucketing, so every write task writes exactly one bucket file, and later
    joins on ``key`` against a shuffle with the same partition count leave
    this side in place. ``sort_by`` orders rows inside each bucket file (by
    time, so window predicates skip row groups). ``shuffle=False`` skips the
    repartition when ``df`` is already hash-partitioned by ``key`` (an
    aggregate by ``key`` is: the same hash picks partitions and buckets).
    """
    source = df.repartition(buckets, key) if shuffle else df
    writer = source.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.option("path", path).saveAsTable(table)


def write_plain(df: DataFrame, path: str) -> None:
    """Store ``df`` as Parquet files as it is partitioned (no shuffle, no key skew)."""
    df.write.mode("overwrite").parquet(path)


def write_by_month(df: DataFrame, path: str, ts: str = "created_at", tie: str | None = None) -> None:
    """Store ``df`` in month directories, rows sorted by time inside every file.

    Report windows are time ranges: the month predicate added by
    :meth:`ReportWindow.restrict` prunes whole directories, and inside a month
    the pushed-down window predicate skips row groups by their min/max
    statistics, which the in-file sort makes narrow. The sort is local to each
    task, so the write adds no shuffle and no sampling pass (a range
    repartition would re-run the whole upstream plan to sample it), and files
    keep the upstream partitioning, which is not keyed by session.
    """
    keys = [ts] + ([tie] if tie else [])
    by_month = df.withColumn(PARTITION_COLUMN, F.expr(PARTITION_SQL)).sortWithinPartitions(PARTITION_COLUMN, *keys)
    by_month.write.mode("overwrite").partitionBy(PARTITION_COLUMN).parquet(path)


def stored_tables(
    spark: SparkSession, sf_dir: str, buckets: int | None = None, variant: Callable[[WebTables], WebTables] | None = None
) -> WebTables:
    """The cleaned tables derived from the driver data, stored once per session.

    The first call derives and cleans them, applies ``variant`` (a named function) and writes them with
    :func:`store_tables` under :func:`trailscope.session.shared_root`; later
    calls return the same DataFrames. Files and catalog tables go when the interpreter ends.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = file_version(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    key = (application_id(spark), id(spark), version, n, variant.__qualname__ if variant else "")
    frames = _FRAMES.get(key)
    if frames is not None:
        return frames
    with _LOCK:  # one materialization per key, even when queries are built from several threads
        return _FRAMES.get(key) or _materialize(spark, sf_dir, key, n, variant)


def store_tables(spark: SparkSession, tables: WebTables, root: str, buckets: int, name_prefix: str) -> WebTables:
    """Write cleaned tables in the layout the reports are planned for, and return them read back.

    Sessions are counted (equal rows are one row with their number, folded before any shuffle, so a row that is repeated over a
    third of the table is one stored row), bucketed by session id and time-sorted in each
    bucket; page views, where one session may hold a large share of the rows,
    go to month directories, time-sorted in each file (windows prune
    directories and skip row groups), and are always pre-aggregated per
    session before a join; orders are stored as they are and once more folded
    per session (``order_facts``), bucketed like the sessions so the two join
    without a shuffle. The written tables also cut the lineage: a lost executor
    costs a re-read, not a recomputation. Bucketed tables are registered as
    ``<name_prefix>_sessions`` and ``<name_prefix>_order_facts``.
    """
    root = root.rstrip("/")
    sessions_table, facts_table = f"{name_prefix}_sessions", f"{name_prefix}_order_facts"
    write_bucketed(count_copies(tables.sessions), sessions_table, f"{root}/sessions", buckets, sort_by=("created_at",))
    write_by_month(tables.pageviews, f"{root}/pageviews", tie="website_pageview_id")
    write_plain(tables.orders, f"{root}/orders")
    facts = order_rollup(spark.read.parquet(f"{root}/orders"))
    write_bucketed(facts, facts_table, f"{root}/order_facts", buckets, shuffle=False)
    return WebTables(
        spark.table(sessions_table),
        spark.read.parquet(f"{root}/pageviews"),
        spark.read.parquet(f"{root}/orders"),
        spark.table(facts_table),
    )


def _materialize(spark: SparkSession, sf_dir: str, key: tuple, n: int, variant: Callable[[WebTables], WebTables] | None) -> WebTables:
    tag = hashlib.sha1(repr(key).encode()).hexdigest()[:10]
    tables = load_tables(spark, sf_dir)
    tables = variant(tables) if variant else tables
    path, prefix = shared_path(spark, f"tables_{tag}"), f"trailscope_{tag}"
    try:
        frames = store_tables(spark, tables, path, n, prefix)
        remove_at_exit(spark, path, (f"{prefix}_sessions", f"{prefix}_order_facts"))
    except AnalysisException as err:  # a catalog that refuses new tables: same results, derived in each query; all else is raised
        warnings.warn(f"stored tables unavailable ({type(err).__name__}); deriving them inside each query")
        remove_path(spark, path)
        frames = tables
    _FRAMES[key] = frames
    return frames
