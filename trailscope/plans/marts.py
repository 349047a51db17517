"""Dashboard tables: the per-session master table and the funnel-chain table.

The reference stores them as materialized views rebuilt by drop-and-create.
Here a mart is written beside the old one and then switched in: a named mart is a view
of its current version, replaced in one step of the catalog; a path is renamed. A rebuild that fails
leaves the old mart as it was, and no reader sees a half-written one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailscope.functions.params import ReportWindow, WebTables, copies_sql
from trailscope.functions.steps import DEFAULT_STEPS
from trailscope.operators.expand import replicate_rows
from trailscope.operators.ranking import entry_pages
from trailscope.operators.rollup import FANOUT_WEIGHT, SID, order_facts, session_rollup, window_pageviews, with_activity
from trailscope.plans.funnel import funnel_table
from trailscope.session import list_folders, remove_path, replace_path, shared_root

E = F.expr

MASTER_COLUMNS = [
    "user_id",
    "website_session_id",
    "created_at",
    "is_repeat_session",
    "utm_source",
    "utm_campaign",
    "device_type",
    "is_bounce",
    "landing_page",
    "is_convert",
    "session_duration",
    "session_total_page",
]


def master_table(tables: WebTables, window: ReportWindow) -> DataFrame:
    """One row per session and order (a session with n orders gives n equal rows).

    Labels: ``is_bounce`` in (``active_session``, ``bounce_session``), ``is_convert``
    in (``convert``, ``not_convert``). ``session_duration`` (minutes, 2 places)
    and ``session_total_page`` are set for active sessions only. A session
    without page views in the window is ``active_session`` with no landing page.

    A repeated first page view multiplies its session's rows. Built from one row
    per session and landing page (page rollup, landing views and order counts
    joined), then expanded by copies times orders with :func:`replicate_rows`, which
    spreads a session with a huge number of orders over many tasks.
    """
    pv = window_pageviews(tables.pageviews, window)
    facts = with_activity(session_rollup(pv))
    landing = entry_pages(pv).select(SID, E("page AS landing_page"), "n_views")
    orders = order_facts(tables).select(SID, "n_orders")
    sessions = tables.sessions.filter(window.contains("created_at"))
    rows = sessions.join(facts, SID, "left").join(landing, SID, "left").join(orders, SID, "left")
    shaped = rows.select(
        "user_id",
        SID,
        "created_at",
        "is_repeat_session",
        "utm_source",
        "utm_campaign",
        "device_type",
        E("CASE WHEN coalesce(is_bounce, FALSE) THEN 'bounce_session' ELSE 'active_session' END AS is_bounce"),
        "landing_page",
        E("CASE WHEN n_orders > 0 THEN 'convert' ELSE 'not_convert' END AS is_convert"),
        # Hundredths of a minute, rounded half up with integer arithmetic (exact).
        E("CAST((active_micros + 300000) div 600000 AS DOUBLE) / 100.0D AS session_duration"),
        E("CAST(active_pages AS BIGINT) AS session_total_page"),
        E(f"{FANOUT_WEIGHT} * coalesce(n_views, 1) * {copies_sql(tables.sessions)} AS __copies"),
    )
    return replicate_rows(shaped, "__copies").select(*MASTER_COLUMNS)


def _is_path(target: str) -> bool:
    return "/" in target or ":" in target


def write_mart(
    df: DataFrame,
    target: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    sort_within: Sequence[str] = (),
) -> None:
    """Replace a mart (see :func:`publish_mart` for a ``target`` without ``/``, a name).

    A path is written beside the old data and takes its place by two renames; only between them it is missing.

    ``sort_within`` orders rows inside each written file (a local sort, no
    shuffle), the stored form of the reference's ORDER BY in a view, which
    otherwise has no guaranteed effect.
    """
    if not _is_path(target):
        publish_mart(df, target, partition_by, fmt, sort_within)
        return
    fresh = f"{target.rstrip('/')}.building-{uuid.uuid4().hex[:12]}"
    _write(df, fresh, partition_by, fmt, sort_within)
    replace_path(df.sparkSession, fresh, target.rstrip("/"))


def _write(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str, sort_within: Sequence[str]) -> None:
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.save(path)
    except Exception:
        remove_path(df.sparkSession, path)
        raise


def _mart_root(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/marts/{name}"


def publish_mart(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    sort_within: Sequence[str] = (),
    root: str | None = None,
) -> str:
    """Write a new version of the named mart and switch its readers over; returns the version's folder.

    The name is a view of one version's folder below ``root`` (by default the shared folder). The version is written whole
    first, then the view is replaced, a single change of the catalog, also where the columns have changed. The version before stays for
    readers that have planned on it; older ones are deleted.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        raise ValueError(f"{name} is a table, not a published mart: drop it first")
    root = (root or _mart_root(spark, name)).rstrip("/")
    path = f"{root}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _write(df, path, partition_by, fmt, sort_within)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fmt}.`{path}`")
    for old in sorted(list_folders(spark, root))[:-2]:
        remove_path(spark, f"{root}/{old}")
    return path


def drop_mart(spark: SparkSession, name: str, root: str | None = None) -> None:
    """Drop the named mart, if it exists, with all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    remove_path(spark, (root or _mart_root(spark, name)).rstrip("/"))


def read_mart(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(target) if _is_path(target) else spark.table(target)


def build_marts(
    tables: WebTables,
    master_window: ReportWindow,
    funnel_window: ReportWindow,
    master_target: str,
    funnel_target: str,
    steps: Mapping[str, int] = DEFAULT_STEPS,
) -> None:
    """Rebuild both dashboard tables, one after the other; each is replaced only when its new version is written."""
    write_mart(master_table(tables, master_window), master_target, sort_within=("user_id", SID))
    write_mart(funnel_table(tables, funnel_window, steps), funnel_target)
