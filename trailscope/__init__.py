"""trailscope: web-traffic analytics for e-commerce sites on Spark DataFrames.

Inputs are three tables (sessions, page views, orders). The library profiles
and cleans them, and builds traffic, conversion, landing-page, funnel and
score-card reports plus two dashboard tables, all as lazy DataFrame plans.
"""

from trailscope.functions.params import ALL_TRAFFIC, ReportWindow, Segment, WebTables
from trailscope.plans.cases import case_reports
from trailscope.plans.cleaning import clean_tables, export_cleaned, quality_report
from trailscope.plans.conversion import conversion_report, landing_conversion
from trailscope.plans.funnel import funnel_report, funnel_table
from trailscope.plans.landing import ab_bounce, bounce_rate, landing_pages
from trailscope.plans.marts import build_marts, master_table, read_mart, write_mart
from trailscope.plans.scorecard import scorecard
from trailscope.plans.traffic import peak_time, top_traffic, weekly_traffic
from trailscope.sources.tables import load_raw_tables, load_tables

__all__ = [
    "ALL_TRAFFIC",
    "ReportWindow",
    "Segment",
    "WebTables",
    "ab_bounce",
    "bounce_rate",
    "build_marts",
    "case_reports",
    "clean_tables",
    "conversion_report",
    "export_cleaned",
    "funnel_report",
    "funnel_table",
    "landing_conversion",
    "landing_pages",
    "load_raw_tables",
    "load_tables",
    "master_table",
    "peak_time",
    "quality_report",
    "read_mart",
    "scorecard",
    "top_traffic",
    "weekly_traffic",
    "write_mart",
]
