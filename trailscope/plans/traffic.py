"""Traffic volume reports: weekly trend, ranking by dimension, peak time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import ALL_TRAFFIC, ReportWindow, Segment, count_sql
from trailscope.functions.timeparts import day_name_sql, hour_1_24_sql, week_start_sql

SID = "website_session_id"
E = F.expr


def _in_scope(sessions: DataFrame, window: ReportWindow, segment: Segment) -> DataFrame:
    return sessions.filter(f"{window.condition('created_at')} AND {segment.condition()}")


def weekly_traffic(
    sessions: DataFrame,
    window: ReportWindow,
    dims: Sequence[str] = (),
    segment: Segment = ALL_TRAFFIC,
    ordered: bool = True,
) -> DataFrame:
    """Sessions per Monday week (and dimensions): ``weekly_date, *dims, total_traffic``.

    Sorted by the dimensions, then the week.
    """
    out = _in_scope(sessions, window, segment).groupBy(E(f"{week_start_sql('created_at')} AS weekly_date"), *dims).agg(
        E(f"{count_sql(sessions, SID)} AS total_traffic")
    )
    if ordered:
        out = out.orderBy(*[F.col(d).asc_nulls_last() for d in (*dims, "weekly_date")])
    return out


def top_traffic(
    sessions: DataFrame,
    window: ReportWindow,
    dims: Sequence[str] = ("utm_source", "utm_campaign"),
    segment: Segment = ALL_TRAFFIC,
    ordered: bool = True,
) -> DataFrame:
    """Sessions (``COUNT(*)``) per dimension values, largest first: ``*dims, total_traffic``."""
    out = _in_scope(sessions, window, segment).groupBy(*dims).agg(E(f"{count_sql(sessions)} AS total_traffic"))
    if ordered:
        out = out.orderBy(F.col("total_traffic").desc_nulls_first(), *[F.col(d).asc_nulls_last() for d in dims])
    return out


def peak_time(sessions: DataFrame, window: ReportWindow, ordered: bool = True) -> DataFrame:
    """Sessions per weekday name and hour (midnight = 24): ``day, hour, total_traffic``.

    Sorted by day name (alphabetically, as the reference sorts), then hour.
    """
    out = (
        sessions.filter(window.contains("created_at"))
        .groupBy(E(f"{day_name_sql('created_at')} AS day"), E(f"{hour_1_24_sql('created_at')} AS hour"))
        .agg(E(f"{count_sql(sessions, SID)} AS total_traffic"))
    )
    if ordered:
        out = out.orderBy("day", "hour")
    return out
