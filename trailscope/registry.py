"""Named queries over the driver data: every report and operator, with fixed parameters.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the three
web tables that Spark derives from the ``events`` table in ``sf_dir``: the
reports read the cleaned tables stored once per session by
:func:`~trailscope.sources.tables.stored_tables`; the data-quality entries read
the raw derivation (before null fills). The parameters mirror the reference's
report windows on the driver data's calendar (January 2024, Monday weeks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES, ReportWindow, Segment, WebTables
from trailscope.functions.steps import step_sql
from trailscope.operators import quality
from trailscope.operators.chains import funnel_chains, successor_pairs
from trailscope.operators.expand import replicate_rows
from trailscope.operators.range_join import join_in_range
from trailscope.operators.ranking import entry_pages, over_ranks, rank_pages
from trailscope.operators.numbering import number_rows
from trailscope.operators.rollup import SID, distinct_counts, session_rollup, window_pageviews, with_activity
from trailscope.plans.cleaning import quality_summary
from trailscope.plans.conversion import conversion_report, landing_conversion
from trailscope.plans.cases import SINGULAR_COLUMNS
from trailscope.plans.funnel import funnel_report, funnel_table
from trailscope.plans.landing import ab_bounce, bounce_rate, landing_pages
from trailscope.plans.marts import master_table, publish_mart, read_mart, write_mart
from trailscope.plans.scorecard import scorecard
from trailscope.plans.traffic import peak_time, top_traffic, weekly_traffic
from trailscope.session import remove_at_exit, shared_path
from trailscope.sources.csv_io import read_csv, write_csv
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS

from trailscope.sources.tables import load_raw_tables, stored_tables

TABLE_SCHEMAS = {"sessions": SESSIONS, "pageviews": PAGEVIEWS, "orders": ORDERS}

# Report parameters on the driver data's calendar.
W = ReportWindow.of("2024-01-01 00:00:00", "2024-01-28 23:59:59")  # four whole Monday weeks
W_UPDATE_WEEKS = ReportWindow.of("2024-01-15 00:00:00", "2024-01-28 23:59:59")  # re-check, whole weeks
W_UPDATE = ReportWindow.of("2024-01-15 00:00:00", "2024-01-30 23:59:59")  # re-check, to the last day
W_AB = ReportWindow.of("2024-01-08 00:00:00", "2024-01-28 23:59:59")  # landing-page A/B test
SEGMENT = Segment("gsearch", "nonbrand")
AB_PAGES = ("/home", "/lander-1")
SOURCE_DIMS = ("utm_source", "utm_campaign")

Query = Callable[[SparkSession, str], DataFrame]
E = F.expr


def _weekly(window: ReportWindow, dims=(), segment=Segment()) -> Query:
    return lambda spark, d: weekly_traffic(stored_tables(spark, d).sessions, window, dims, segment)


def _conversion(window: ReportWindow, dims, segment=Segment()) -> Query:
    return lambda spark, d: conversion_report(stored_tables(spark, d), window, dims, segment)


def _bounce(window: ReportWindow) -> Query:
    return lambda spark, d: bounce_rate(stored_tables(spark, d), window, ("/home",), SEGMENT)


def _original_names(name: str, query: Query) -> Query:
    """The report under the column names of the original script."""
    return lambda spark, d: query(spark, d).withColumnsRenamed(SINGULAR_COLUMNS[name])


def _null_profile(table: str) -> Query:
    return lambda spark, d: quality.null_profile(getattr(load_raw_tables(spark, d), table))


def _duplicates(table: str, load=stored_tables) -> Query:
    cols = TABLE_SCHEMAS[table].fieldNames()

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = getattr(load(spark, d), table)
        return quality.duplicate_rows(df.select(*cols, *[c for c in df.columns if c == COPIES]))

    return query


def _with_repeats(t: WebTables) -> WebTables:
    """Every fourth page view, fifth session and third order row a second time."""

    def twice(df: DataFrame, rows: str) -> DataFrame:
        return df.unionByName(df.filter(rows))

    return WebTables(
        twice(t.sessions, f"{SID} % 5 = 0"), twice(t.pageviews, "website_pageview_id % 4 = 0"), twice(t.orders, f"{SID} % 3 = 0")
    )


def repeated_tables(spark: SparkSession, d: str) -> WebTables:
    """The web tables with repeated rows, stored like the others:
    the original flow reports repeated rows and leaves them in, so the reports must count them."""
    return stored_tables(spark, d, variant=_with_repeats)


def _session_rows(tables: WebTables) -> DataFrame:
    """The sessions, one row per row (they are stored counted)."""
    return quality.expand_copies(tables.sessions)


#: Queries that are registered a second time, as ``<name>_repeated``, over :func:`repeated_tables`.
REPEATED_QUERIES: dict[str, Query] = {
    "conversion_by_source": lambda s, d: conversion_report(repeated_tables(s, d), W, SOURCE_DIMS),
    "landing_pages": lambda s, d: landing_pages(repeated_tables(s, d), W, SEGMENT),
    "bounce_rate": lambda s, d: bounce_rate(repeated_tables(s, d), W, ("/home",), SEGMENT),
    "ab_bounce": lambda s, d: ab_bounce(repeated_tables(s, d), W_AB, AB_PAGES, SEGMENT).withColumnsRenamed(SINGULAR_COLUMNS["ab_bounce"]),
    "ab_conversion": lambda s, d: landing_conversion(repeated_tables(s, d), W_AB, AB_PAGES, SEGMENT).withColumnsRenamed(
        SINGULAR_COLUMNS["ab_conversion"]
    ),
    "funnel_report": lambda s, d: funnel_report(repeated_tables(s, d), W),
    "funnel_table": lambda s, d: funnel_table(repeated_tables(s, d), W),
    "scorecard": lambda s, d: scorecard(repeated_tables(s, d), W),
    "master_table": lambda s, d: master_table(repeated_tables(s, d), W),
    "page_rank": lambda s, d: _page_rank(repeated_tables(s, d)),
    "successor_join": lambda s, d: _successors(repeated_tables(s, d)),
    "range_join_steps": lambda s, d: _range_join_steps(repeated_tables(s, d)),
    "range_join_first_hour": lambda s, d: _range_join_first_hour(repeated_tables(s, d)),
    "numbered_sessions": lambda s, d: q_numbered_sessions(s, d, repeated_tables),
    "conditional_distinct": lambda s, d: _step_sessions(repeated_tables(s, d)),
    "weekly_traffic": lambda s, d: weekly_traffic(repeated_tables(s, d).sessions, W),
    "top_sources": lambda s, d: top_traffic(repeated_tables(s, d).sessions, W, SOURCE_DIMS),
    "peak_time": lambda s, d: peak_time(repeated_tables(s, d).sessions, W),
    "quality_summary": lambda s, d: quality_summary(_with_repeats(load_raw_tables(s, d))),
    "null_recheck": lambda s, d: quality.null_profile(repeated_tables(s, d).sessions),
    "fill_nulls": lambda s, d: _session_rows(repeated_tables(s, d)),
    "duplicate_rows_sessions": _duplicates("sessions", repeated_tables),
    "duplicate_rows_pageviews": _duplicates("pageviews", repeated_tables),
    "duplicate_rows_orders": _duplicates("orders", repeated_tables),
}


def _active_facts(spark: SparkSession, d: str) -> DataFrame:
    return with_activity(session_rollup(window_pageviews(stored_tables(spark, d).pageviews, W)))


def _page_rank(tables: WebTables) -> DataFrame:
    return rank_pages(W.restrict(tables.pageviews).select(SID, "website_pageview_id", "pageview_url"))


def _successors(tables: WebTables) -> DataFrame:
    pv = W.restrict(tables.pageviews).select(SID, "website_pageview_id", "pageview_url")
    return over_ranks(pv, successor_pairs)


def q_session_landing_page(spark: SparkSession, d: str) -> DataFrame:
    landed = entry_pages(W.restrict(stored_tables(spark, d).pageviews))
    return landed.select(SID, E("page AS landing_page"), "n_views").transform(lambda df: replicate_rows(df, "n_views")).drop("n_views")


def q_bounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _active_facts(spark, d).filter("is_bounce").select(SID)


def q_session_duration(spark: SparkSession, d: str) -> DataFrame:
    facts = _active_facts(spark, d).filter("active_micros IS NOT NULL")
    return facts.select(SID, E("CAST(active_micros AS DOUBLE) / 60000000.0D AS duration"))


def q_pages_per_session(spark: SparkSession, d: str) -> DataFrame:
    facts = _active_facts(spark, d).filter("active_pages IS NOT NULL")
    return facts.select(SID, E("CAST(active_pages AS BIGINT) AS total_page"))


def q_user_first_visit(spark: SparkSession, d: str) -> DataFrame:
    s = stored_tables(spark, d).sessions.filter(f"{W.condition('created_at')} AND is_repeat_session = 0")
    return s.groupBy("user_id").agg(E("min(created_at) AS start_date"))


def q_first_visit_join(spark: SparkSession, d: str) -> DataFrame:
    """Sessions flagged as their user's first visit: a left join on (user, timestamp).

    The key pairs a user with a timestamp, so even a user with a third of all
    sessions spreads over many join keys.
    """
    s = _session_rows(stored_tables(spark, d)).filter(W.contains("created_at")).select(SID, "user_id", "created_at")
    first = q_user_first_visit(spark, d).select("user_id", E("start_date AS created_at"), E("1 AS __first"))
    return s.join(first, ["user_id", "created_at"], "left").select(
        SID, "user_id", "created_at", E("CAST(coalesce(__first, 0) AS INT) AS is_first_visit")
    )


def q_semi_join_segment(spark: SparkSession, d: str) -> DataFrame:
    t = stored_tables(spark, d)
    return window_pageviews(t.pageviews, W, t.sessions, SEGMENT).select(*PAGEVIEWS.fieldNames())


def q_anti_join_active(spark: SparkSession, d: str) -> DataFrame:
    pv = window_pageviews(stored_tables(spark, d).pageviews, W)
    # A bounced session has one page view, so its id joins the key: a session with many page views spreads over tasks.
    bounced = pv.groupBy(SID).agg(E("count(1) AS __n"), E("min(website_pageview_id) AS __pv")).filter("__n = 1")
    bounced = bounced.select(E(f"{SID} AS __sid"), "__pv")
    return pv.join(bounced, E(f"{SID} <=> __sid AND website_pageview_id <=> __pv"), "left_anti").select(*PAGEVIEWS.fieldNames())


def q_anti_join_left_null(spark: SparkSession, d: str) -> DataFrame:
    t = stored_tables(spark, d)
    s = _session_rows(t).filter(W.contains("created_at")).select(SID, "user_id", "created_at")
    # Distinct session ids first (map-side), so a session with many page views is one row.
    seen = window_pageviews(t.pageviews, W_AB).select(SID).distinct()
    return s.join(seen, SID, "left_anti")


def _range_join_steps(tables: WebTables) -> DataFrame:
    """Every step of a session's valid chain with each page view of the session in the window (the original funnel's last join)."""
    pv = W.restrict(tables.pageviews).select(SID, "website_pageview_id", "pageview_url")
    steps = over_ranks(pv, funnel_chains).filter("is_valid_step = 1").select(SID, "funnel_step")
    return join_in_range(steps, tables.pageviews, W, ("website_pageview_id",))


def _range_join_first_hour(tables: WebTables) -> DataFrame:
    """The page views of the segment's sessions in the hour after each session's start."""
    started = _session_rows(tables).filter(f"{W_AB.condition('created_at')} AND {SEGMENT.condition()}").select(SID, E("created_at AS started_at"))
    return join_in_range(started, tables.pageviews, ("started_at", "started_at + INTERVAL '1' HOUR"))


def q_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    s = stored_tables(spark, d).sessions.filter(W.contains("created_at"))
    per_user = s.groupBy("user_id").agg(E("max(is_repeat_session = 1) AS repeat"))
    return per_user.agg(
        E("CAST(count(user_id) AS BIGINT) AS total_user"),
        E("CAST(count_if(user_id IS NOT NULL AND repeat) AS BIGINT) AS repeat_user"),
    )


def _step_sessions(tables: WebTables) -> DataFrame:
    pv = window_pageviews(tables.pageviews, W)
    pairs = pv.select(E(f"{step_sql('pageview_url')} AS funnel_step"), SID).filter("funnel_step IS NOT NULL")
    return distinct_counts(pairs, "funnel_step")


def q_union_all(spark: SparkSession, d: str) -> DataFrame:
    s = stored_tables(spark, d).sessions
    first = weekly_traffic(s, W, ordered=False).withColumn("period", E("'launch'"))
    later = weekly_traffic(s, W_UPDATE_WEEKS, ordered=False).withColumn("period", E("'update'"))
    return first.unionByName(later)


def q_desc_nulls_first_sort(spark: SparkSession, d: str) -> DataFrame:
    rep = conversion_report(stored_tables(spark, d), W, SOURCE_DIMS, ordered=False)
    order = [F.col("total_sales").desc_nulls_first(), F.col("utm_source").asc_nulls_last(), F.col("utm_campaign").asc_nulls_last()]
    return number_rows(rep, order, "sort_rank").withColumn("sort_rank", E("CAST(sort_rank AS INT)"))


def q_numbered_sessions(spark: SparkSession, d: str, load=stored_tables) -> DataFrame:
    """All sessions numbered by traffic source (descending, missing first) and time; equal rows get consecutive numbers."""
    rows = _session_rows(load(spark, d)).select("utm_source", "created_at", SID)
    return number_rows(rows, [F.col("utm_source").desc_nulls_first(), F.col("created_at").asc_nulls_last(), F.col(SID).asc_nulls_last()])


def q_null_rows_head(spark: SparkSession, d: str) -> DataFrame:
    raw = load_raw_tables(spark, d).sessions
    return quality.head(quality.null_rows(raw, "utm_source"), 5, [SID])


def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv_roundtrip/website_sessions")
    write_csv(_session_rows(stored_tables(spark, d)), path)
    return read_csv(spark, path, SESSIONS)


def q_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Orders with columns of mixed cells, written as text and read back without a schema."""
    mixed = stored_tables(spark, d).orders.select(
        *ORDERS.fieldNames(),
        E(f"CASE WHEN {SID} % 100 = 7 THEN 'gift' ELSE CAST(items_purchased AS STRING) END AS note"),
        E(f"CASE WHEN {SID} % 3 = 0 THEN 'NA' ELSE CAST(items_purchased AS STRING) END AS discount"),
        E(f"CASE WHEN {SID} % 2 = 0 THEN 'True' ELSE 'false' END AS is_gift"),
        E(f"CASE WHEN {SID} % 2 = 0 THEN '1.50e1' ELSE ' 7' END AS weight"),
        E("'n/a' AS coupon"),
    )
    path = shared_path(spark, "csv_inferred/orders")
    write_csv(mixed, path)
    return read_csv(spark, path, infer=True)


def q_mart_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "marts/master_table")
    write_mart(master_table(stored_tables(spark, d), W), path)
    return read_mart(spark, path)


def _published(build: Callable[[WebTables, ReportWindow], DataFrame], name: str) -> Query:
    """The mart published under a name, replaced by a second version, and read back by that name."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        tables, root = stored_tables(spark, d), remove_at_exit(spark, shared_path(spark, f"marts/{name}"))
        mart = f"trailscope_{name}_{root.rsplit('-', 1)[1]}"
        publish_mart(build(tables, W_UPDATE), mart, root=root)
        publish_mart(build(tables, W), mart, root=root)
        return read_mart(spark, mart)

    return query


def queries() -> dict[str, Query]:
    return {
        # Analyses
        "weekly_traffic": _weekly(W),
        "weekly_traffic_by_source": _weekly(W, SOURCE_DIMS),
        "weekly_traffic_by_device": _weekly(W, ("device_type",), SEGMENT),
        "top_sources": lambda s, d: top_traffic(stored_tables(s, d).sessions, W, SOURCE_DIMS),
        "device_split": lambda s, d: top_traffic(stored_tables(s, d).sessions, W, ("device_type",), SEGMENT),
        "conversion_by_source": _conversion(W, SOURCE_DIMS),
        "conversion_by_device": _conversion(W, ("device_type",), SEGMENT),
        "conversion_segment_update": _original_names(
            "conversion_segment_update", _conversion(W_UPDATE, SOURCE_DIMS, SEGMENT)
        ),
        "landing_pages": lambda s, d: landing_pages(stored_tables(s, d), W, SEGMENT),
        "bounce_rate": _bounce(W),
        "bounce_rate_update": _original_names("bounce_rate_update", _bounce(W_UPDATE)),
        "weekly_traffic_update": _weekly(W_UPDATE_WEEKS),
        "ab_bounce": _original_names(
            "ab_bounce", lambda s, d: ab_bounce(stored_tables(s, d), W_AB, AB_PAGES, SEGMENT)
        ),
        "ab_conversion": _original_names(
            "ab_conversion",
            lambda s, d: landing_conversion(stored_tables(s, d), W_AB, AB_PAGES, SEGMENT),
        ),
        "funnel_report": lambda s, d: funnel_report(stored_tables(s, d), W),
        "peak_time": lambda s, d: peak_time(stored_tables(s, d).sessions, W),
        "scorecard": lambda s, d: scorecard(stored_tables(s, d), W),
        "scorecard_strict_outliers": lambda s, d: scorecard(stored_tables(s, d), W, strict_outliers=True),
        "master_table": lambda s, d: master_table(stored_tables(s, d), W),
        "funnel_table": lambda s, d: funnel_table(stored_tables(s, d), W),
        # Data quality
        "null_profile_sessions": _null_profile("sessions"),
        "null_profile_pageviews": _null_profile("pageviews"),
        "null_profile_orders": _null_profile("orders"),
        "null_rows": lambda s, d: quality.null_rows(load_raw_tables(s, d).sessions, "utm_source"),
        "null_rows_head": q_null_rows_head,
        "fill_nulls": lambda s, d: _session_rows(stored_tables(s, d)),
        "null_recheck": lambda s, d: quality.null_profile(stored_tables(s, d).sessions),
        "quality_summary": lambda s, d: quality_summary(load_raw_tables(s, d)),
        "duplicate_rows_sessions": _duplicates("sessions"),
        "duplicate_rows_pageviews": _duplicates("pageviews"),
        "duplicate_rows_orders": _duplicates("orders"),
        "csv_roundtrip": q_csv_roundtrip,
        "csv_inferred": q_csv_inferred,
        # Building blocks and single operators
        "page_rank": lambda s, d: _page_rank(stored_tables(s, d)),
        "session_landing_page": q_session_landing_page,
        "bounce_sessions": q_bounce_sessions,
        "session_duration": q_session_duration,
        "pages_per_session": q_pages_per_session,
        "user_first_visit": q_user_first_visit,
        "first_visit_join": q_first_visit_join,
        "semi_join_segment": q_semi_join_segment,
        "anti_join_active": q_anti_join_active,
        "anti_join_left_null": q_anti_join_left_null,
        "successor_join": lambda s, d: _successors(stored_tables(s, d)),
        "range_join_steps": lambda s, d: _range_join_steps(stored_tables(s, d)),
        "range_join_first_hour": lambda s, d: _range_join_first_hour(stored_tables(s, d)),
        "distinct_users": q_distinct_users,
        "conditional_distinct": lambda s, d: _step_sessions(stored_tables(s, d)),
        "union_all": q_union_all,
        "desc_nulls_first_sort": q_desc_nulls_first_sort,
        "mart_roundtrip": q_mart_roundtrip,
        "master_mart": _published(master_table, "master_table"),
        "funnel_mart": _published(funnel_table, "funnel_table"),
        "numbered_sessions": q_numbered_sessions,
    } | {f"{name}_repeated": query for name, query in REPEATED_QUERIES.items()}
