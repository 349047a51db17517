"""The site's four business cases as one call: every report with its original parameters.

``case_reports(tables)`` returns the 19 analyses of the launch review, the
re-check after optimization, the landing-page A/B test, the funnel and peak-time
study, the score card and the two dashboard tables, each as a lazy DataFrame,
so a user of the original SQL script gets the same reports by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from trailscope.functions.params import ReportWindow, Segment, WebTables
from trailscope.plans.conversion import conversion_report, landing_conversion
from trailscope.plans.funnel import funnel_report, funnel_table
from trailscope.plans.landing import ab_bounce, bounce_rate, landing_pages
from trailscope.plans.marts import master_table
from trailscope.plans.scorecard import scorecard
from trailscope.plans.traffic import peak_time, top_traffic, weekly_traffic

# The report windows (inclusive) and parameters of the four business cases.
LAUNCH_WEEKS = ReportWindow.of("2012-03-19 00:00:00", "2012-04-29 23:59:59")
LAUNCH = ReportWindow.of("2012-03-19 00:00:00", "2012-04-30 23:59:59")
RECHECK_WEEKS = ReportWindow.of("2012-04-30 00:00:00", "2012-05-27 23:59:59")
RECHECK = ReportWindow.of("2012-04-30 00:00:00", "2012-05-31 23:59:59")
AB_TEST = ReportWindow.of("2012-06-19 00:00:00", "2012-07-31 23:59:59")
FUNNEL_STUDY = ReportWindow.of("2012-03-19 00:00:00", "2012-07-31 23:59:59")
MASTER_TABLE = ReportWindow.of("2012-03-19 00:00:00", "2012-12-31 23:59:59")
FUNNEL_TABLE = ReportWindow.of("2012-03-01 00:00:00", "2012-12-31 23:59:59")
GSEARCH_NONBRAND = Segment("gsearch", "nonbrand")
AB_PAGES = ("/home", "/lander-1")
SOURCE = ("utm_source", "utm_campaign")
DEVICE = ("device_type",)
# Reports whose original columns are named in the singular.
SINGULAR_COLUMNS = {
    "bounce_rate_update": {"total_sessions": "total_session", "total_bounces": "total_bounce"},
    "conversion_segment_update": {"total_sessions": "total_session", "total_orders": "total_order"},
    "ab_bounce": {"total_sessions": "total_session", "total_bounces": "total_bounce"},
    "ab_conversion": {"total_sessions": "total_session", "total_orders": "total_order"},
}


def case_reports(tables: WebTables, ordered: bool = True) -> dict[str, DataFrame]:
    """Every analysis of the four cases by name, as lazy (by default sorted) DataFrames,
    with the column names of the original reports."""
    s, seg = tables.sessions, GSEARCH_NONBRAND
    reports = {
        # Case 1: the first month after launch.
        "weekly_traffic": weekly_traffic(s, LAUNCH_WEEKS, ordered=ordered),
        "weekly_traffic_by_source": weekly_traffic(s, LAUNCH_WEEKS, SOURCE, ordered=ordered),
        "weekly_traffic_by_device": weekly_traffic(s, LAUNCH_WEEKS, DEVICE, seg, ordered=ordered),
        "top_sources": top_traffic(s, LAUNCH, SOURCE, ordered=ordered),
        "device_split": top_traffic(s, LAUNCH, DEVICE, seg, ordered=ordered),
        "conversion_by_source": conversion_report(tables, LAUNCH, SOURCE, ordered=ordered),
        "conversion_by_device": conversion_report(tables, LAUNCH, DEVICE, seg, ordered=ordered),
        "landing_pages": landing_pages(tables, LAUNCH, seg, ordered=ordered),
        "bounce_rate": bounce_rate(tables, LAUNCH, ("/home",), seg),
        # Case 2: re-check after optimizing the segment and the home page.
        "weekly_traffic_update": weekly_traffic(s, RECHECK_WEEKS, ordered=ordered),
        "bounce_rate_update": bounce_rate(tables, RECHECK, ("/home",), seg),
        "conversion_segment_update": conversion_report(tables, RECHECK, SOURCE, seg, ordered=ordered),
        # Case 3: landing-page A/B test.
        "ab_bounce": ab_bounce(tables, AB_TEST, AB_PAGES, seg, ordered=ordered),
        "ab_conversion": landing_conversion(tables, AB_TEST, AB_PAGES, seg, ordered=ordered),
        # Case 4: funnel and peak time, then the score card and the dashboard tables.
        "funnel_report": funnel_report(tables, FUNNEL_STUDY),
        "peak_time": peak_time(s, FUNNEL_STUDY, ordered=ordered),
        "scorecard": scorecard(tables, FUNNEL_STUDY),
        "master_table": master_table(tables, MASTER_TABLE),
        "funnel_table": funnel_table(tables, FUNNEL_TABLE),
    }
    for name, renames in SINGULAR_COLUMNS.items():
        reports[name] = reports[name].withColumnsRenamed(renames)
    return reports
