"""The site score card: ten KPIs in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES, ReportWindow, WebTables, times_copies_sql
from trailscope.functions.ratios import money_sql, round_ratio_half_up_sql, safe_ratio_sql
from trailscope.operators.rollup import FANOUT_WEIGHT, SID, order_facts, session_rollup, window_pageviews, with_activity

E = F.expr


def scorecard(tables: WebTables, window: ReportWindow, strict_outliers: bool = False) -> DataFrame:
    """``total_user, repeat_user, total_session, active_session, bounce_session,
    avg_session_duration, avg_page_session, conversion_rate, total_sales, total_revenue``.

    Session counts follow ``sessions LEFT JOIN orders``: a session with n orders
    counts n times (the reference's fan-out), reproduced by weights on one row
    per session. Distinct users come from a per-user pre-aggregate instead of two
    distinct counts, so there is no ``Expand`` and a heavy user is folded
    map-side. ``avg_session_duration`` is in minutes (first to last page view of
    active sessions); ``total_revenue`` is sales minus cost (gross margin);
    ``conversion_rate`` is a percentage.
    """
    facts = with_activity(session_rollup(window_pageviews(tables.pageviews, window)), strict_outliers)
    sessions = tables.sessions.filter(window.contains("created_at"))
    sessions = sessions.select(SID, "user_id", "is_repeat_session", *[c for c in (COPIES,) if c in sessions.columns])
    per_session = sessions.join(facts, SID, "left").join(order_facts(tables), SID, "left")
    w = f"CASE WHEN {SID} IS NOT NULL THEN {times_copies_sql(sessions, FANOUT_WEIGHT)} END"
    bounce = "coalesce(is_bounce, FALSE)"
    per_user = per_session.groupBy("user_id").agg(
        *[
            E(a)
            for a in (
                "max(is_repeat_session = 1) AS repeat",
                f"sum({w}) AS sessions",
                f"sum(CASE WHEN NOT {bounce} THEN {w} END) AS active",
                f"sum(CASE WHEN {bounce} THEN {w} END) AS bounced",
                f"sum({w} * CAST(active_micros AS DECIMAL(20,0))) AS micros",
                f"sum(CASE WHEN active_micros IS NOT NULL THEN {w} END) AS n_micros",
                f"sum({w} * active_pages) AS pages",
                f"sum(CASE WHEN active_pages IS NOT NULL THEN {w} END) AS n_pages",
                f"sum({times_copies_sql(sessions, 'n_orders')}) AS orders",
                f"sum({times_copies_sql(sessions, 'sales', decimal=True)}) AS sales",
                f"sum({times_copies_sql(sessions, 'cost', decimal=True)}) AS cost",
            )
        ]
    )
    total = per_user.agg(
        *[
            E(a)
            for a in (
                "CAST(count(user_id) AS BIGINT) AS total_user",
                "CAST(count_if(user_id IS NOT NULL AND repeat) AS BIGINT) AS repeat_user",
                "CAST(coalesce(sum(sessions), 0) AS BIGINT) AS total_session",
                "CAST(coalesce(sum(active), 0) AS BIGINT) AS active_session",
                "CAST(coalesce(sum(bounced), 0) AS BIGINT) AS bounce_session",
                "sum(micros) AS __micros",
                "sum(n_micros) AS __n_micros",
                "sum(pages) AS __pages",
                "sum(n_pages) AS __n_pages",
                "coalesce(sum(orders), 0) AS __orders",
                "sum(sales) AS __sales",
                "sum(cost) AS __cost",
            )
        ]
    )
    return total.select(
        "total_user",
        "repeat_user",
        "total_session",
        "active_session",
        "bounce_session",
        E(f"{round_ratio_half_up_sql('__micros', '__n_micros * 60000000')} AS avg_session_duration"),
        E(f"{round_ratio_half_up_sql('__pages', '__n_pages')} AS avg_page_session"),
        E(f"{safe_ratio_sql('__orders', 'total_session')} * 100.0D AS conversion_rate"),
        E(f"{money_sql('__sales')} AS total_sales"),
        E(f"{money_sql('__sales - __cost', 4)} AS total_revenue"),
    )
