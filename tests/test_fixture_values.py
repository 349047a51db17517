"""The expected values of FIXTURES.md section 2 at every scale (computed independently in Spark and DuckDB)."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest

from trailscope import registry
from trailscope.operators.quality import null_profile
from trailscope.sources.tables import load_raw_tables

# FIXTURES.md section 2, "Expected values", per scale.
EXPECTED = {
    "0.001": dict(
        rows=(397, 1000, 144), multi_order=19, nulls=(90, 137), weekly=(94, 99, 89, 87), q9=(35, 9),
        q13={"/home": (25, 6), "/lander-1": (19, 5)},
        q14={"/home": (25, 5, "507.11"), "/lander-1": (19, 5, "244.15")},
        q15=(294, 192, 88, 35, 13, 3, 1), q19=(22, 1), q16=(134, 369, 8),
        q17=(15, 15, 390, 305, 85, 679.76, 3.07, 34.8718, "11007.56", "6604.5360"),
        q18=(390, 369, 85, 136, 159, 207326.5, 935),
    ),
    "0.01": dict(
        rows=(4006, 10000, 1378), multi_order=173, nulls=(822, 1372), weekly=(922, 943, 935, 938), q9=(307, 76),
        q13={"/home": (241, 64), "/lander-1": (204, 41)},
        q14={"/home": (241, 56, "3815.53"), "/lander-1": (204, 61, "5763.38")},
        q15=(3003, 1721, 782, 298, 94, 29, 9), q19=(265, 10), q16=(168, 3738, 59),
        q17=(150, 150, 3909, 2866, 1043, 681.47, 3.13, 32.5915, "93055.28", "55833.1680"),
        q18=(3909, 3738, 1043, 1274, 1665, 1953100.6, 8983),
    ),
    "0.1": dict(
        rows=(40083, 100000, 14096), multi_order=1769, nulls=(8047, 13541), weekly=(9348, 9377, 9304, 9363),
        q9=(3156, 859),
        q13={"/home": (2394, 669), "/lander-1": (2139, 580)},
        q14={"/home": (2394, 632, "47792.83"), "/lander-1": (2139, 612, "45746.51")},
        q15=(29749, 17359, 7609, 2857, 849, 222, 51), q19=(2846, 73), q16=(168, 37392, 551),
        q17=(1500, 1500, 39228, 29133, 10095, 687.22, 3.12, 33.522, "984658.15", "590794.8900"),
        q18=(39228, 37392, 10095, 13150, 16466, 20020817.7, 90752),
    ),
}
STEPS = ("total_sessions", "product_sessions", "proddetail_sessions", "cart_sessions", "shipping_sessions",
         "billing_sessions", "thanks_sessions")


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_values(spark, sf):
    d = f"/root/testdata/sf{sf}"
    if not os.path.exists(d):
        pytest.skip("driver data not present")
    e, q = EXPECTED[sf], registry.queries()
    raw = load_raw_tables(spark, d)
    assert (raw.sessions.count(), raw.pageviews.count(), raw.orders.count()) == e["rows"]
    assert raw.orders.groupBy("website_session_id").count().filter("count > 1").count() == e["multi_order"]
    nulls = {r.column_name: r.null_count for r in null_profile(raw.sessions).collect()}
    assert (nulls["utm_source"], nulls["utm_campaign"], nulls["http_referer"], nulls["utm_content"]) == (
        e["nulls"][0], e["nulls"][0], e["nulls"][0], e["nulls"][1])

    weekly = sorted(tuple(r) for r in q["weekly_traffic"](spark, d).collect())
    assert weekly == [(dt.date(2024, 1, day), n) for day, n in zip((1, 8, 15, 22), e["weekly"])]
    b = q["bounce_rate"](spark, d).collect()[0]
    assert (b.total_sessions, b.total_bounces) == e["q9"]
    ab = {r.pageview_url: (r.total_session, r.total_bounce) for r in q["ab_bounce"](spark, d).collect()}
    assert ab == e["q13"]
    conv = {r.pageview_url: (r.total_session, r.total_order, str(r.total_sales)) for r in q["ab_conversion"](spark, d).collect()}
    assert conv == e["q14"]
    f = q["funnel_report"](spark, d).collect()[0]
    assert tuple(f[c] for c in STEPS) == e["q15"]
    invalid = {r.funnel_step: r["count"] for r in
               q["funnel_table"](spark, d).filter("is_valid_step IS NULL").groupBy("funnel_step").count().collect()}
    assert (invalid.get(1, 0), invalid.get(2, 0)) == e["q19"]
    cells = [r.total_traffic for r in q["peak_time"](spark, d).collect()]
    assert (len(cells), sum(cells), max(cells)) == e["q16"]

    s = q["scorecard"](spark, d).collect()[0]
    assert (s.total_user, s.repeat_user, s.total_session, s.active_session, s.bounce_session) == e["q17"][:5]
    assert (s.avg_session_duration, s.avg_page_session) == e["q17"][5:7]
    assert round(s.conversion_rate, 4) == e["q17"][7]
    assert (str(s.total_sales), str(s.total_revenue)) == e["q17"][8:]

    m = q["master_table"](spark, d)
    agg = m.selectExpr(
        "count(*) AS n", "count(DISTINCT website_session_id) AS sessions",
        "count_if(is_bounce = 'bounce_session') AS bounces", "count_if(is_convert = 'convert') AS converts",
        "count_if(landing_page = '/home') AS home",
        # Durations are 2-place values; sum them exactly, then round half up to 1 place.
        "round(sum(CAST(session_duration AS DECIMAL(20,2))), 1) AS minutes", "sum(session_total_page) AS pages",
    ).collect()[0]
    assert (agg.n, agg.sessions, agg.bounces, agg.converts, agg.home) == e["q18"][:5]
    assert agg.minutes == Decimal(str(e["q18"][5])) and agg.pages == e["q18"][6]
