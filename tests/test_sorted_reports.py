"""The order of all sorted reports: descending nulls first, ascending nulls last, dimensions as tie-breaks."""

from __future__ import annotations

import os

import pytest

from trailscope import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")

SOURCE, DEVICE = ["utm_source", "utm_campaign"], ["device_type"]
ORDERS = {
    "weekly_traffic": ["weekly_date"],
    "weekly_traffic_by_source": [*SOURCE, "weekly_date"],
    "weekly_traffic_by_device": [*DEVICE, "weekly_date"],
    "weekly_traffic_update": ["weekly_date"],
    "top_sources": ["-total_traffic", *SOURCE],
    "device_split": ["-total_traffic", *DEVICE],
    "conversion_by_source": ["-total_sales", *SOURCE],
    "conversion_by_device": ["-total_sales", *DEVICE],
    "conversion_segment_update": ["-total_sales", *SOURCE],
    "landing_pages": ["-total_landing_traffic", "pageview_url"],
    "ab_bounce": ["pageview_url"],
    "ab_conversion": ["-conversion_rate", "pageview_url"],
    "peak_time": ["day", "hour"],
}


def _key(row, order):
    out = []
    for c in order:
        v = row[c.removeprefix("-")]
        out += [v is not None, -v if v is not None else 0] if c.startswith("-") else [v is None, v if v is not None else 0]
    return out


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_report_is_sorted(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and rows == sorted(rows, key=lambda r: _key(r, ORDERS[name]))
