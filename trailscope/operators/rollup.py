"""Per-session facts from page views and orders (one pass each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import ALL_TRAFFIC, ReportWindow, Segment, WebTables, sql_str
from trailscope.functions.timeparts import micros_between_sql
from trailscope.operators.ranking import entry_pages

SID = "website_session_id"
E = F.expr


def segment_sessions(sessions: DataFrame, segment: Segment) -> DataFrame:
    """Ids of the sessions in a traffic segment."""
    return sessions.filter(segment.predicate()).select(SID)


def window_pageviews(
    pageviews: DataFrame,
    window: ReportWindow,
    sessions: DataFrame | None = None,
    segment: Segment = ALL_TRAFFIC,
) -> DataFrame:
    """Page views inside ``window``; with a segment, only those of its sessions.

    The segment test is a left-semi join (``EXISTS``) on raw page views; the
    reports use :func:`in_segment` instead, which joins after folding per
    session. The window predicate is pushed into the Parquet scan.
    """
    pv = window.restrict(pageviews)
    if not segment.is_all:
        if sessions is None:
            raise ValueError("a segment needs the sessions table")
        # A computed key: bucketed sessions are shuffled as well, so adaptive execution can split a hot session.
        pv = pv.join(segment_sessions(sessions, segment).select(E(f"{SID} ^ 0 AS {SID}")), SID, "left_semi")
    return pv


def page_index_sql(url: str, pages: Sequence[str]) -> str:
    """Position of ``url`` in ``pages`` (0-based), -1 for any other page."""
    arms = " ".join(f"WHEN {url} = {sql_str(p)} THEN {i}" for i, p in enumerate(pages))
    return f"CASE {arms} ELSE -1 END" if arms else "-1"


def session_rollup(pv: DataFrame, flag_pages: Sequence[str] = ()) -> DataFrame:
    """One row per session: ``n_pages`` (non-null page-view ids; a bounce has exactly one), ``first_ts``, ``last_ts``.

    For each url in ``flag_pages`` a 0/1 column ``seen_<i>`` tells whether the
    session viewed it. All buffers have a fixed width, so Spark keeps a hash
    aggregate with map-side partial results: a session with a third of all page
    views is folded before the shuffle.
    """
    aggs = [
        "count(website_pageview_id) AS n_pages",
        "min(created_at) AS first_ts",
        "max(created_at) AS last_ts",
    ]
    aggs += [f"max(CAST(pageview_url = {sql_str(p)} AS INT)) AS seen_{i}" for i, p in enumerate(flag_pages)]
    return pv.groupBy(SID).agg(*[E(a) for a in aggs])


def in_segment(facts: DataFrame, sessions: DataFrame | None, segment: Segment) -> DataFrame:
    """The per-session ``facts`` of the segment's sessions.

    Page views are folded per session first and joined second, so the join sees
    few rows per session and a session with a huge number of page views never
    lands in one join task. A session's facts depend only on its own page
    views, so the order of the two steps does not change the result.
    """
    if segment.is_all:
        return facts
    if sessions is None:
        raise ValueError("a segment needs the sessions table")
    return facts.join(segment_sessions(sessions, segment), SID, "left_semi")


def entry_facts(
    pageviews: DataFrame,
    window: ReportWindow,
    pages: Sequence[str],
    sessions: DataFrame | None = None,
    segment: Segment = ALL_TRAFFIC,
) -> DataFrame:
    """One row per session: ``landed_<i>``, its landing views (rank 1) on ``pages[i]``, and ``is_bounce``.

    More than one landing view means a repeated page view. Two entry pages tell
    a bounce (one page-view id in the window) from any longer visit.
    """
    entries = entry_pages(window.restrict(pageviews), 2, page_index_sql("pageview_url", pages))
    landed = [
        E(f"CAST(sum(CASE WHEN rank_page = 1 AND page = {i} THEN n_views ELSE 0 END) AS BIGINT) AS landed_{i}")
        for i in range(len(pages))
    ]
    facts = entries.groupBy(SID).agg(*landed, E("sum(n_ids) = 1 AS is_bounce"))
    return in_segment(facts, sessions, segment)


def with_activity(rollup: DataFrame, strict_outliers: bool = False) -> DataFrame:
    """Add ``is_bounce`` and, for active sessions, ``active_micros`` and ``active_pages``.

    ``active_micros`` is the time from the first to the last page view (the
    dwell time on the last page is unknown). The reference's outlier filter is
    ``< 1 day OR > 1 minute``, always true; ``strict_outliers`` applies AND.
    """
    micros = micros_between_sql("first_ts", "last_ts")
    keep = "n_pages <> 1"
    if strict_outliers:
        keep += f" AND {micros} < {1440 * 60_000_000} AND {micros} > 60000000"
    return rollup.select(
        "*",
        E("n_pages = 1 AS is_bounce"),
        E(f"CASE WHEN {keep} THEN {micros} END AS active_micros"),
        E("CASE WHEN n_pages <> 1 THEN n_pages END AS active_pages"),
    )


def order_rollup(orders: DataFrame) -> DataFrame:
    """One row per ordering session: ``n_orders`` (order rows), ``sales``, ``cost``.

    Pre-aggregating orders before any join keeps every later join one-to-one on
    the session key; the fan-out of the reference's session-to-orders join is
    reproduced by weights (:data:`FANOUT_WEIGHT`), not by multiplying rows.
    """
    return orders.groupBy(SID).agg(
        E(f"count({SID}) AS n_orders"),
        E("sum(items_purchased * price_usd) AS sales"),
        E("sum(items_purchased * cogs_usd) AS cost"),
    )


def distinct_counts(df: DataFrame, group: str, key: str = SID, out: str = "sessions") -> DataFrame:
    """``COUNT(DISTINCT key)`` per ``group``, exact, for keys that are serial numbers.

    A bitmap of the keys per group and bucket of 32,768 numbers is built by each map task, so one bit per key, not a row, is
    shuffled, once for all groups; a key that holds most rows is one bit as well.
    """
    bits = df.filter(f"{key} IS NOT NULL").groupBy(group, E(f"bitmap_bucket_number({key}) AS __bucket")).agg(
        E(f"bitmap_construct_agg(bitmap_bit_position({key})) AS __bits")
    )
    return bits.groupBy(group).agg(E(f"CAST(sum(bitmap_count(__bits)) AS BIGINT) AS {out}"))


def order_facts(tables: WebTables) -> DataFrame:
    """Orders folded per session: the stored ``tables.order_facts`` if present, else :func:`order_rollup`."""
    return tables.order_facts if tables.order_facts is not None else order_rollup(tables.orders)


# Rows a session contributes to ``sessions LEFT JOIN orders``: max(orders, 1).
FANOUT_WEIGHT = "greatest(coalesce(n_orders, 0), 1)"
