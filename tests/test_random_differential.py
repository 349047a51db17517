"""The analyses against their oracle SQL (DuckDB) on random, adversarial web tables."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from trailscope import (
    ab_bounce,
    bounce_rate,
    conversion_report,
    funnel_report,
    funnel_table,
    landing_conversion,
    landing_pages,
    master_table,
    peak_time,
    scorecard,
    top_traffic,
    weekly_traffic,
)
from trailscope.functions.params import WebTables
from trailscope.oracles import oracle_sql, over_tables
from trailscope.plans.cases import SINGULAR_COLUMNS
from trailscope.registry import AB_PAGES, SEGMENT, SOURCE_DIMS, W, W_AB, W_UPDATE, W_UPDATE_WEEKS
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS
from tests.compare import rows_of

URLS = ["/home", "/lander-1", "/products", "/the-original-mr-fuzzy", "/the-forever-love-bear", "/cart",
        "/shipping", "/billing", "/thank-you-for-your-order", "/other"]
SOURCES = [("gsearch", "nonbrand"), ("gsearch", "brand"), ("bsearch", "brand"), ("direct", "noncampaign")]


def random_tables(seed: int, repeats: bool = False):
    rng = random.Random(seed)
    base = dt.datetime(2023, 12, 30)
    sessions, pageviews, orders, pid = [], [], [], 0
    for sid in range(1, 121):
        start = base + dt.timedelta(seconds=rng.randrange(0, 35 * 86400))
        src, camp = rng.choice(SOURCES)
        user = rng.randrange(1, 30) if rng.random() < 0.95 else None  # a few sessions without a user
        sessions.append((sid, start, user, rng.choice([0, 1]), src, camp, "c",
                         rng.choice(["desktop", "mobile"]), "r"))
        t = start
        walk = rng.random() < 0.5
        for j in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):  # some sessions have no page views
            pid += rng.choice([1, 2])
            url = URLS[min(j, 8)] if walk and rng.random() < 0.85 else rng.choice(URLS)
            pageviews.append((pid, t, sid, url))
            t += dt.timedelta(seconds=rng.choice([0, 1, 30, 3600, 3 * 86400]))  # equal times, window edges
        for _ in range(rng.choice([0, 0, 0, 1, 1, 3])):  # several orders per session
            price = Decimal(rng.randrange(100, 9999)) / 100
            orders.append((sid, rng.choice([1, 2]), price, (price * Decimal("0.4")).quantize(Decimal("0.0001"))))
    for k in range(5):  # page views and orders of sessions that do not exist
        pid += 1
        pageviews.append((pid, base + dt.timedelta(days=10 + k), 10_000 + k, "/home"))
        orders.append((20_000 + k, 1, Decimal("5.00"), Decimal("2.0000")))
    if repeats:  # the cleaning reports repeated rows and leaves them in
        sessions += rng.sample(sessions, 20)
        pageviews += rng.choices(pageviews, k=len(pageviews) // 4)
        orders += rng.choices(orders, k=10)
    return sessions, pageviews, orders


def duck_views(sessions, pageviews, orders):
    con = duckdb.connect()
    con.register("s_df", pd.DataFrame(sessions, columns=SESSIONS.fieldNames()))
    con.register("p_df", pd.DataFrame(pageviews, columns=PAGEVIEWS.fieldNames()))
    con.register("o_df", pd.DataFrame([(a, b, str(c), str(d)) for a, b, c, d in orders], columns=ORDERS.fieldNames()))
    con.execute("""CREATE VIEW website_sessions AS SELECT CAST(website_session_id AS BIGINT) AS website_session_id,
        CAST(created_at AS TIMESTAMP) AS created_at, CAST(user_id AS BIGINT) AS user_id,
        CAST(is_repeat_session AS INTEGER) AS is_repeat_session, utm_source, utm_campaign, utm_content, device_type,
        http_referer FROM s_df""")
    con.execute("CREATE VIEW raw_sessions AS SELECT * FROM website_sessions")
    con.execute("""CREATE VIEW website_pageviews AS SELECT CAST(website_pageview_id AS BIGINT) AS website_pageview_id,
        CAST(created_at AS TIMESTAMP) AS created_at, CAST(website_session_id AS BIGINT) AS website_session_id,
        pageview_url FROM p_df""")
    con.execute("""CREATE VIEW website_orders AS SELECT CAST(website_session_id AS BIGINT) AS website_session_id,
        CAST(items_purchased AS INTEGER) AS items_purchased, CAST(price_usd AS DECIMAL(10,2)) AS price_usd,
        CAST(cogs_usd AS DECIMAL(12,4)) AS cogs_usd FROM o_df""")
    return con


REPORTS = {
    "weekly_traffic": lambda t: weekly_traffic(t.sessions, W, ordered=False),
    "weekly_traffic_by_source": lambda t: weekly_traffic(t.sessions, W, SOURCE_DIMS, ordered=False),
    "weekly_traffic_update": lambda t: weekly_traffic(t.sessions, W_UPDATE_WEEKS, ordered=False),
    "top_sources": lambda t: top_traffic(t.sessions, W, SOURCE_DIMS, ordered=False),
    "device_split": lambda t: top_traffic(t.sessions, W, ("device_type",), SEGMENT, ordered=False),
    "conversion_by_source": lambda t: conversion_report(t, W, SOURCE_DIMS, ordered=False),
    "conversion_segment_update": lambda t: conversion_report(t, W_UPDATE, SOURCE_DIMS, SEGMENT, ordered=False)
    .withColumnsRenamed(SINGULAR_COLUMNS["conversion_segment_update"]),
    "landing_pages": lambda t: landing_pages(t, W, SEGMENT, ordered=False),
    "bounce_rate": lambda t: bounce_rate(t, W, ("/home",), SEGMENT),
    "ab_bounce": lambda t: ab_bounce(t, W_AB, AB_PAGES, SEGMENT, ordered=False)
    .withColumnsRenamed(SINGULAR_COLUMNS["ab_bounce"]),
    "ab_conversion": lambda t: landing_conversion(t, W_AB, AB_PAGES, SEGMENT, ordered=False)
    .withColumnsRenamed(SINGULAR_COLUMNS["ab_conversion"]),
    "funnel_report": lambda t: funnel_report(t, W),
    "funnel_table": lambda t: funnel_table(t, W),
    "peak_time": lambda t: peak_time(t.sessions, W, ordered=False),
    "scorecard": lambda t: scorecard(t, W),
    "scorecard_strict_outliers": lambda t: scorecard(t, W, strict_outliers=True),
    "master_table": lambda t: master_table(t, W),
}


@pytest.mark.parametrize("seed", [int(s) for s in __import__("os").environ.get("DIFF_SEEDS", "11,12").split(",")])
@pytest.mark.parametrize("repeats", [False, True])
def test_analyses_match_oracle_sql_on_random_tables(spark, seed, repeats):
    sessions, pageviews, orders = random_tables(seed, repeats)
    tables = WebTables(
        spark.createDataFrame(sessions, SESSIONS),
        spark.createDataFrame(pageviews, PAGEVIEWS),
        spark.createDataFrame(orders, ORDERS),
    )
    con = duck_views(sessions, pageviews, orders)
    sqls = oracle_sql()
    assert W_UPDATE.lo < W_UPDATE.hi
    for name, build in REPORTS.items():
        df = build(tables)
        res = con.execute(over_tables(sqls[name]))
        d_cols = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(d_cols), name
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(d_cols, res.fetchall()), name
