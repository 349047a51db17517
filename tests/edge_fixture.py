"""Hand-built edge fixture on the reference's own calendar (FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from trailscope.functions.params import WebTables
from trailscope.operators.quality import fill_nulls
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


SESSION_ROWS = [
    (1, "2012-03-19 00:00:00", 1, 0, "gsearch", "nonbrand", "mobile"),
    (2, "2012-03-25 23:59:59", 2, 0, "gsearch", "nonbrand", "desktop"),
    (3, "2012-04-29 23:59:59.500000", 3, 0, "gsearch", "nonbrand", "desktop"),
    (4, "2012-04-30 12:00:00", 1, 1, None, None, "desktop"),
    (5, "2012-04-01 08:00:00", 4, 0, "bsearch", "brand", "mobile"),
    (6, "2012-04-30 23:59:50", 5, 0, "gsearch", "nonbrand", "mobile"),
    (7, "2012-06-20 10:00:00", 6, 0, "gsearch", "nonbrand", "mobile"),
    (8, "2012-06-21 10:00:00", 7, 0, "gsearch", "nonbrand", "desktop"),
    (9, "2012-06-22 10:00:00", 8, 0, "gsearch", "nonbrand", "desktop"),
    (10, "2012-08-01 10:00:00", 9, 0, "gsearch", "brand", "desktop"),
]

FUNNEL_PATH = [
    "/home",
    "/products",
    "/the-original-mr-fuzzy",
    "/cart",
    "/shipping",
    "/billing",
    "/thank-you-for-your-order",
]

PAGEVIEW_ROWS = (
    [(1, "2012-03-19 00:00:00", 1, "/home")]
    + [(2 + i, f"2012-03-26 00:0{i}:00", 2, url) for i, url in enumerate(FUNNEL_PATH)]
    + [
        (9, "2012-04-29 23:59:59.500000", 3, "/home"),
        (10, "2012-04-30 00:00:30", 3, "/products"),
        (11, "2012-04-30 00:01:00", 3, "/products"),
        (12, "2012-04-30 12:00:00", 4, "/products"),
        (13, "2012-04-30 12:01:00", 4, "/home"),
        (14, "2012-04-30 12:02:00", 4, "/products"),
        (15, "2012-04-30 23:59:55", 6, "/home"),
        (16, "2012-05-01 00:00:05", 6, "/products"),
        (17, "2012-06-20 10:00:00", 7, "/lander-1"),
        (18, "2012-06-21 10:00:00", 8, "/lander-1"),
        (19, "2012-06-21 10:01:00", 8, "/products"),
        (20, "2012-06-22 10:00:00", 9, "/home"),
        (21, "2012-06-22 10:02:30", 9, "/lander-1"),
        (22, "2012-08-01 10:00:00", 10, "/home"),
    ]
)

ORDER_ROWS = [
    (2, 1, Decimal("49.99"), Decimal("19.49")),
    (2, 2, Decimal("59.99"), Decimal("22.49")),
    (8, 1, Decimal("49.99"), Decimal("19.49")),
]


def raw_edge_tables(spark) -> WebTables:
    sessions = spark.createDataFrame(
        [
            (sid, T(ts), user, rep, src, camp, None if src is None else "g_ad_1", dev, None if src is None else f"https://www.{src}.com")
            for sid, ts, user, rep, src, camp, dev in SESSION_ROWS
        ],
        SESSIONS,
    )
    pageviews = spark.createDataFrame([(pid, T(ts), sid, url) for pid, ts, sid, url in PAGEVIEW_ROWS], PAGEVIEWS)
    orders = spark.createDataFrame(ORDER_ROWS, ORDERS)
    return WebTables(sessions, pageviews, orders)


def edge_tables(spark) -> WebTables:
    raw = raw_edge_tables(spark)
    return raw._replace(sessions=fill_nulls(raw.sessions))
