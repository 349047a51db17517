"""Derive the three web tables from the driver's ``events`` table.

The test data has no web-shop tables, so sessions, page views and orders are
derived from ``events(event_id, ts, user_id, event_type, value, props)`` by a
fixed rule (documented in FIXTURES.md). The oracle SQL repeats the same rule.

Per event: ``sid = user_id * 100 + day(ts)``, ``k`` = the integer in
``props``, ``r`` = position of the event in its session by ``event_id``.

Scale notes: only ``r <= 7`` matters (later pages are ``/other``), so the
position comes from a ``row_number() <= 7`` window that Spark plans with a
partial ``WindowGroupLimit`` *before* the shuffle: a session holding a third of
all events still sends at most 7 rows per map task. Positions are attached back
with a join on the unique ``event_id``, and the first-session flag joins on the
user's first event id, so no join key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import WebTables, sql_str

E = F.expr

# Page by position for events with k >= 25 (position 3 = product page by event_id % 3).
PATH_BY_POSITION = {
    2: "/products",
    4: "/cart",
    5: "/shipping",
    6: "/billing",
    7: "/thank-you-for-your-order",
}
PRODUCT_PAGES = ["/the-original-mr-fuzzy", "/the-forever-love-bear", "/the-birthday-sugar-panda"]
# Page by event type for events with k < 25.
PATH_BY_EVENT = {"view": "/home", "click": "/products", "signup": "/cart", "purchase": "/billing"}
# Traffic source by k % 5 (4 = no source).
SOURCE_BY_K5 = {0: "gsearch", 1: "gsearch", 2: "bsearch", 3: "socialbook"}


def _base(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        E("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k"),
        E("user_id * 100 + dayofmonth(ts) AS sid"),
    )


def _head_positions(ev: DataFrame) -> DataFrame:
    """First seven events of every session with their position ``r``."""
    return (
        ev.select("sid", "event_id", "ts", "user_id", "k")
        .withColumn("r", E("row_number() OVER (PARTITION BY sid ORDER BY event_id)"))
        .filter("r <= 7")
    )


def _url_sql() -> str:
    products = " ".join(f"WHEN {i} THEN {sql_str(p)}" for i, p in enumerate(PRODUCT_PAGES[:-1]))
    by_pos = " ".join(f"WHEN r = {pos} THEN {sql_str(page)}" for pos, page in PATH_BY_POSITION.items())
    by_type = " ".join(f"WHEN {sql_str(t)} THEN {sql_str(p)}" for t, p in PATH_BY_EVENT.items())
    return (
        "CASE WHEN k >= 25 THEN CASE "
        "WHEN r = 1 THEN CASE WHEN event_id % 2 = 0 THEN '/home' ELSE '/lander-1' END "
        f"WHEN r = 3 THEN CASE event_id % 3 {products} ELSE {sql_str(PRODUCT_PAGES[-1])} END "
        f"{by_pos} ELSE '/other' END "
        f"ELSE CASE event_type {by_type} ELSE '/error' END END"
    )


def derive_pageviews(ev: DataFrame, head: DataFrame) -> DataFrame:
    pos = head.select("event_id", "r")
    return ev.join(pos, "event_id", "left").select(
        E("event_id AS website_pageview_id"),
        E("ts AS created_at"),
        E("sid AS website_session_id"),
        E(f"{_url_sql()} AS pageview_url"),
    )


def derive_sessions(ev: DataFrame, head: DataFrame) -> DataFrame:
    first_event = ev.groupBy("user_id").agg(E("min(event_id) AS event_id")).select("event_id", E("1 AS is_first"))
    # The user's first event opens the user's first session: join on that (unique) event id.
    joined = head.filter("r = 1").join(first_event, "event_id", "left")
    source = "CASE k % 5 " + " ".join(f"WHEN {m} THEN {sql_str(s)}" for m, s in SOURCE_BY_K5.items()) + " END"
    return joined.select(
        E("sid AS website_session_id"),
        E("ts AS created_at"),
        "user_id",
        E("CAST(CASE WHEN is_first IS NULL THEN 1 ELSE 0 END AS INT) AS is_repeat_session"),
        E(f"{source} AS utm_source"),
        E("CASE WHEN k % 5 = 4 THEN CAST(NULL AS STRING) WHEN k % 2 = 0 THEN 'nonbrand' ELSE 'brand' END AS utm_campaign"),
        E("CASE WHEN k % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('g_ad_', CAST(k % 2 AS STRING)) END AS utm_content"),
        E("CASE WHEN k % 10 < 6 THEN 'desktop' ELSE 'mobile' END AS device_type"),
        E(f"concat('https://www.', {source}, '.com') AS http_referer"),
    )


def derive_orders(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'purchase' AND k < 70").select(
        E("sid AS website_session_id"),
        E("CAST(1 + k % 2 AS INT) AS items_purchased"),
        E("CAST(value AS DECIMAL(10,2)) AS price_usd"),
        E("CAST(CAST(value AS DECIMAL(10,2)) * 0.4BD AS DECIMAL(12,4)) AS cogs_usd"),
    )


def derive_web_tables(events: DataFrame) -> WebTables:
    """Raw (uncleaned) sessions, page views and orders derived from ``events``."""
    ev = _base(events)
    head = _head_positions(ev)
    return WebTables(derive_sessions(ev, head), derive_pageviews(ev, head), derive_orders(ev))
