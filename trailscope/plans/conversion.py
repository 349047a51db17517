"""Conversion reports: sessions, orders, conversion rate and sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import ALL_TRAFFIC, COPIES, ReportWindow, Segment, WebTables, sql_str, times_copies_sql
from trailscope.functions.ratios import money_sql, safe_ratio_sql
from trailscope.operators.rollup import FANOUT_WEIGHT, SID, entry_facts, order_facts

E = F.expr


def conversion_report(
    tables: WebTables,
    window: ReportWindow,
    dims: Sequence[str] = ("utm_source", "utm_campaign"),
    segment: Segment = ALL_TRAFFIC,
    ordered: bool = True,
) -> DataFrame:
    """``*dims, total_sessions, total_orders, conversion_rate, total_sales``.

    Same numbers as ``sessions LEFT JOIN orders`` grouped by ``dims``: a session
    with n orders counts n times as a session and n times as an order (the
    reference's fan-out). Orders are folded per session first, so the join is
    one-to-one and a session with a huge number of orders costs one row.
    Sorted by sales, largest first, NULL sales first (as the reference's engine
    sorts descending).
    """
    counted = [COPIES] if COPIES in tables.sessions.columns else []
    s = tables.sessions.filter(f"{window.condition('created_at')} AND {segment.condition()}").select(SID, *dims, *counted)
    joined = s.join(order_facts(tables), SID, "left")
    rows, orders = times_copies_sql(s, FANOUT_WEIGHT), times_copies_sql(s, "n_orders")
    out = joined.groupBy(*dims).agg(
        E(f"CAST(coalesce(sum(CASE WHEN {SID} IS NOT NULL THEN {rows} END), 0) AS BIGINT) AS total_sessions"),
        E(f"CAST(coalesce(sum({orders}), 0) AS BIGINT) AS total_orders"),
        E(f"{money_sql('sum(' + times_copies_sql(s, 'sales', decimal=True) + ')')} AS total_sales"),
    )
    out = out.select(
        *dims,
        "total_sessions",
        "total_orders",
        E(f"{safe_ratio_sql('total_orders', 'total_sessions')} AS conversion_rate"),
        "total_sales",
    )
    if ordered:
        out = out.orderBy(F.col("total_sales").desc_nulls_first(), *[F.col(d).asc_nulls_last() for d in dims])
    return out


def landing_conversion(
    tables: WebTables,
    window: ReportWindow,
    pages: Sequence[str] = ("/home", "/lander-1"),
    segment: Segment = ALL_TRAFFIC,
    ordered: bool = True,
) -> DataFrame:
    """A/B conversion per landing page:
    ``pageview_url, total_sessions, total_orders, conversion_rate, total_sales``.

    ``total_orders`` counts *converting sessions* (sales are summed per session
    first; a repeated landing view counts once per copy, its session's sales once per pair
    of copies, as the original joins do). Landing pages come from the page views inside ``window``; orders are
    not limited to the window.
    """
    variants = list(dict.fromkeys(pages))
    facts = entry_facts(tables.pageviews, window, variants, tables.sessions, segment)
    rows = ", ".join(f"named_struct('pageview_url', {sql_str(p)}, 'views', landed_{i})" for i, p in enumerate(variants))
    every = " + ".join(f"landed_{i}" for i in range(len(variants)))
    landed = facts.select(SID, E(f"{every} AS all_views"), E(f"inline(array({rows}))")).filter("views > 0")
    per_session = order_facts(tables).select(SID, "sales", E("1 AS __ordered"))
    joined = landed.join(per_session, SID, "left")
    out = joined.groupBy("pageview_url").agg(
        E("CAST(sum(views) AS BIGINT) AS total_sessions"),
        E("CAST(coalesce(sum(views * __ordered), 0) AS BIGINT) AS total_orders"),
        E(f"{money_sql('sum(sales * CAST(views * all_views AS DECIMAL(10,0)))')} AS total_sales"),
    )
    out = out.select(
        "pageview_url",
        "total_sessions",
        "total_orders",
        E(f"{safe_ratio_sql('total_orders', 'total_sessions')} AS conversion_rate"),
        "total_sales",
    )
    if ordered:
        out = out.orderBy(F.col("conversion_rate").desc_nulls_first(), F.col("pageview_url").asc_nulls_last())
    return out
