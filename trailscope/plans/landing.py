"""Landing-page reports: ranking, bounce rate, A/B bounce comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import ALL_TRAFFIC, ReportWindow, Segment, WebTables, count_sql, sql_str
from trailscope.functions.ratios import safe_ratio_sql
from trailscope.operators.ranking import entry_pages
from trailscope.operators.rollup import SID, entry_facts, in_segment, session_rollup

E = F.expr


def landing_pages(
    tables: WebTables,
    window: ReportWindow,
    segment: Segment = ALL_TRAFFIC,
    first_time_only: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Sessions per landing page: ``pageview_url, total_landing_traffic``.

    The landing page is the first page view inside the window; the session must
    itself start inside the window and, by default, be a first-time visit. A
    repeated first page view counts once per copy, as does a repeated session.
    Landing views are folded per session first; one join then brings the number
    of session rows that pass the window and first-visit tests.
    """
    cond = f"{window.condition('created_at')} AND {segment.condition()}"
    if first_time_only:
        cond += " AND is_repeat_session = 0"
    keep = tables.sessions.filter(cond).groupBy(SID).agg(E(f"{count_sql(tables.sessions)} AS __rows"))
    landed = entry_pages(window.restrict(tables.pageviews)).join(keep, SID)
    out = landed.groupBy(E("page AS pageview_url")).agg(E("CAST(sum(n_views * __rows) AS BIGINT) AS total_landing_traffic"))
    if ordered:
        out = out.orderBy(F.col("total_landing_traffic").desc_nulls_first(), F.col("pageview_url").asc_nulls_last())
    return out


def bounce_rate(
    tables: WebTables,
    window: ReportWindow,
    pages: Sequence[str] = ("/home",),
    segment: Segment = ALL_TRAFFIC,
) -> DataFrame:
    """One row: ``total_sessions`` landing on ``pages``, ``total_bounces`` (one page
    view in the window) and ``bounce_rate``."""
    pages = list(dict.fromkeys(pages))
    facts = entry_facts(tables.pageviews, window, pages, tables.sessions, segment)
    landed = " + ".join(f"landed_{i}" for i in range(len(pages))) or "0"
    out = facts.agg(
        E(f"CAST(coalesce(sum({landed}), 0) AS BIGINT) AS total_sessions"),
        E(f"CAST(count_if(is_bounce AND {landed} > 0) AS BIGINT) AS total_bounces"),
    )
    return out.select("*", E(f"{safe_ratio_sql('total_bounces', 'total_sessions')} AS bounce_rate"))


def ab_bounce(
    tables: WebTables,
    window: ReportWindow,
    pages: Sequence[str] = ("/home", "/lander-1"),
    segment: Segment = ALL_TRAFFIC,
    ordered: bool = True,
) -> DataFrame:
    """Bounce rate per page variant: ``pageview_url, total_sessions, total_bounces, bounce_rate``.

    A variant is listed when any page view in the window shows it, even if no
    session landed there (then its rate is NULL). Landing views and a seen-flag
    per variant are folded per session, and one global aggregate folds both.
    """
    variants = list(dict.fromkeys(pages))
    landed = entry_facts(tables.pageviews, window, variants, tables.sessions, segment)
    seen = session_rollup(window.restrict(tables.pageviews), flag_pages=variants)
    facts = landed.unionByName(in_segment(seen, tables.sessions, segment), allowMissingColumns=True)
    aggs = []
    for i in range(len(variants)):
        aggs += [
            f"max(seen_{i}) AS s{i}",
            f"coalesce(sum(landed_{i}), 0) AS t{i}",
            f"count_if(is_bounce AND landed_{i} > 0) AS b{i}",
        ]
    wide = facts.agg(*[E(a) for a in aggs])
    rows = ", ".join(
        f"named_struct('pageview_url', {sql_str(p)}, 'seen', s{i}, 'total_sessions', CAST(t{i} AS BIGINT), "
        f"'total_bounces', CAST(b{i} AS BIGINT))"
        for i, p in enumerate(variants)
    )
    out = (
        wide.select(E(f"inline(array({rows}))"))
        .filter("seen = 1")
        .select(
            "pageview_url",
            "total_sessions",
            "total_bounces",
            E(f"{safe_ratio_sql('total_bounces', 'total_sessions')} AS bounce_rate"),
        )
    )
    if ordered:
        out = out.orderBy("pageview_url")
    return out
