"""Derived fixture: expected values on the driver data (FIXTURES.md section 2) and the entry contract."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from trailscope import registry
from trailscope.operators.quality import null_profile
from trailscope.sources.tables import load_raw_tables, load_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")


def test_derived_row_counts(spark):
    t = load_raw_tables(spark, SF)
    assert (t.sessions.count(), t.pageviews.count(), t.orders.count()) == (397, 1000, 144)
    multi = t.orders.groupBy("website_session_id").count().filter("count > 1").count()
    assert multi == 19
    nulls = {r.column_name: r.null_count for r in null_profile(t.sessions).collect()}
    assert nulls["utm_source"] == nulls["utm_campaign"] == nulls["http_referer"] == 90
    assert nulls["utm_content"] == 137


def test_expected_reports(spark):
    q = registry.queries()
    weekly = sorted(tuple(r) for r in q["weekly_traffic"](spark, SF).collect())
    assert weekly == [(dt.date(2024, 1, d), n) for d, n in [(1, 94), (8, 99), (15, 89), (22, 87)]]
    b = q["bounce_rate"](spark, SF).collect()[0]
    assert (b.total_sessions, b.total_bounces) == (35, 9)
    f = q["funnel_report"](spark, SF).collect()[0]
    assert [f[c] for c in ["total_sessions", "product_sessions", "proddetail_sessions", "cart_sessions",
                           "shipping_sessions", "billing_sessions", "thanks_sessions"]] == [294, 192, 88, 35, 13, 3, 1]
    s = q["scorecard"](spark, SF).collect()[0]
    assert (s.total_user, s.repeat_user, s.total_session, s.active_session, s.bounce_session) == (15, 15, 390, 305, 85)
    assert (s.avg_session_duration, s.avg_page_session) == (679.76, 3.07)
    assert str(s.total_sales) == "11007.56" and str(s.total_revenue) == "6604.5360"
    assert q["master_table"](spark, SF).count() == 390
    invalid = q["funnel_table"](spark, SF).filter("is_valid_step IS NULL").groupBy("funnel_step").count().collect()
    assert {r.funnel_step: r["count"] for r in invalid} == {1: 22, 2: 1}


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["utm_source", "utm_campaign", "total_sessions", "total_orders", "conversion_rate", "total_sales"]
    assert df.count() == 7
    assert set(registry.queries()) <= set(e.oracle_sql()) <= set(e.queries())


def test_every_query_plans(spark):
    # Analysis only (no execution): every registered query resolves against the data.
    for name, fn in registry.queries().items():
        if name in ("csv_roundtrip", "mart_roundtrip"):
            continue
        assert fn(spark, SF).schema is not None, name
    assert load_tables(spark, SF).sessions.columns[0] == "website_session_id"


def test_properties_on_driver_data(spark):
    sf = "/root/testdata/sf0.01"
    q = registry.queries()
    s = q["scorecard"](spark, sf).collect()[0]
    assert s.active_session + s.bounce_session == s.total_session
    weekly = sum(r.total_traffic for r in q["weekly_traffic"](spark, sf).collect())
    in_window = registry.stored_tables(spark, sf).sessions.filter(registry.W.contains("created_at")).count()
    assert weekly == in_window  # the window is whole Monday weeks
    funnel = q["funnel_report"](spark, sf).collect()[0]
    steps = [funnel[c] for c in ("total_sessions", "product_sessions", "proddetail_sessions", "cart_sessions",
                                 "shipping_sessions", "billing_sessions", "thanks_sessions")]
    assert steps == sorted(steps, reverse=True)
    assert q["master_table"](spark, sf).count() == s.total_session  # one row per session and order


def test_stored_tables_fall_back_to_derivation(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    from trailscope.sources import tables as tables_module

    def refuse(*args, **kwargs):
        raise AnalysisException("catalog refuses new tables")

    monkeypatch.setattr(tables_module, "store_tables", refuse)
    monkeypatch.setattr(tables_module, "_FRAMES", {})
    with pytest.warns(UserWarning, match="deriving them inside each query"):
        t = tables_module.stored_tables(spark, SF, buckets=3)
    assert t.order_facts is None and t.sessions.count() == 397
    assert registry.queries()["bounce_rate"](spark, SF).collect()[0].total_sessions == 35


def test_failed_writes_are_raised(spark, monkeypatch):
    from trailscope.sources import tables as tables_module

    def broken(*args, **kwargs):
        raise RuntimeError("disk full")

    monkeypatch.setattr(tables_module, "store_tables", broken)
    monkeypatch.setattr(tables_module, "_FRAMES", {})
    with pytest.raises(RuntimeError, match="disk full"):
        tables_module.stored_tables(spark, SF, buckets=3)
