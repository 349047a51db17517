"""Inputs that once changed results: user columns with layout names, repeated page views, awkward cells."""

from __future__ import annotations

import datetime as dt

import pytest

from trailscope.functions.params import ReportWindow
from trailscope.operators.chains import funnel_chains, funnel_depth, successor_pairs
from trailscope.sources.csv_io import read_csv, write_csv

WINDOW = ReportWindow.of("2024-01-01", "2024-01-31")
RANKED = "website_session_id long, pageview_url string, rank_page int"


def test_user_month_column_is_no_filter(spark):
    at = dt.datetime(2024, 1, 5)
    df = spark.createDataFrame([(1, at, dt.date(2024, 2, 1)), (2, at, None)], "id long, created_at timestamp_ntz, created_month date")
    assert WINDOW.restrict(df).count() == 2


def test_tied_page_views_end_chains(spark):
    # Session 1: /home twice with one id (rank 1, 1), then /products at rank 3. Session 2: an unbroken chain.
    rows = [(1, "/home", 1), (1, "/home", 1), (1, "/products", 3), (2, "/home", 1), (2, "/products", 2), (2, "/products", 2)]
    ranked = spark.createDataFrame(rows, RANKED)
    assert {(r.website_session_id, r.depth) for r in funnel_depth(ranked).collect()} == {(1, 1), (2, 2)}
    pairs = [(r.website_session_id, r.from_url, r.to_url, r.from_step, r.from_rank) for r in successor_pairs(ranked).collect()]
    assert pairs == [(2, "/home", "/products", 1, 1)] * 2
    chains = sorted((r.website_session_id, r.pageview_url, r.user_page_step) for r in funnel_chains(ranked).collect())
    assert chains == [(1, "/home", 1)] * 2 + [(2, "/home", 1)] + [(2, "/products", 2)] * 2


def test_csv_keeps_blanks_and_line_feeds(spark, tmp_path):
    cells = [" lead", "trail ", "a\nb", 'q"x']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    write_csv(df, f"file://{tmp_path}/c")
    assert sorted(r.c for r in read_csv(spark, f"file://{tmp_path}/c", multi_line=True).collect()) == sorted(cells)


def test_integers_written_as_decimals(spark):
    """pandas writes an integer column with missing values as 1.0; a true fraction is refused."""
    text = spark.createDataFrame([("1.0", "2.5"), ("12", "3.0"), (None, "4")], "a string, b string")
    from pyspark.sql import types as T

    from trailscope.sources.schemas import cast_by_name

    ints = cast_by_name(text, T.StructType([T.StructField("a", T.LongType())]))
    assert [r.a for r in ints.collect()] == [1, 12, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_by_name(text, T.StructType([T.StructField("b", T.IntegerType())])).collect()
