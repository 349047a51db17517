"""The inner join with a time range in ON: exact rows, pruned scans, split hot sessions."""

from __future__ import annotations

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from trailscope.functions.params import ReportWindow
from trailscope.operators.range_join import join_in_range
from trailscope.operators.ranking import hot_sessions
from trailscope.sources.schemas import PAGEVIEWS
from trailscope.sources.tables import write_by_month

T0 = dt.datetime(2024, 1, 1)
HOT = 7
VIEWS = ("website_pageview_id", "created_at", "pageview_url")


def _views(spark, n_hot: int = 2000, months: int = 4):
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(months * 30 * 1440)), HOT if i < n_hot else rng.randrange(100, 160), "/home") for i in range(n_hot + 400)]
    rows += [rows[0]] * 500  # one page view repeated
    rows += [(9999, None, HOT, "/home"), (9998, T0, None, "/home")]
    return spark.createDataFrame(rows, PAGEVIEWS).repartition(6)


def _left(spark):
    rng = random.Random(4)
    rows = [(s, T0 + dt.timedelta(days=rng.randrange(35, 55)), rng.randrange(1, 2880)) for s in [HOT, HOT, HOT, *range(100, 150), None]]
    return spark.createDataFrame([*rows, (HOT, None, 5)], "website_session_id long, since timestamp_ntz, minutes int")


def _brute(left, views, bounds):
    out = []
    for row in left.collect():
        lo, hi = bounds(row)
        out += [
            (*row, v.website_pageview_id, v.created_at, v.pageview_url)
            for v in views.collect_rows
            if row.website_session_id is not None and v.website_session_id == row.website_session_id and None not in (lo, hi, v.created_at) and lo <= v.created_at <= hi
        ]
    return sorted(map(str, out))


@pytest.fixture()
def views(spark):
    df = _views(spark)
    df.collect_rows = df.collect()
    return df


@pytest.mark.parametrize("chunk_rows", [64, 1 << 20])
def test_row_bounds_match_brute_force(spark, views, chunk_rows):
    left = _left(spark)
    got = join_in_range(left, views, ("since", "since + make_dt_interval(0, 0, minutes)"), chunk_rows=chunk_rows)
    assert got.columns == [*left.columns, *VIEWS]

    def bounds(r):
        return (r.since, r.since + dt.timedelta(minutes=r.minutes)) if r.since else (None, None)

    assert sorted(map(str, map(tuple, got.collect()))) == _brute(left, views, bounds)


def test_window_bounds_match_brute_force(spark, views):
    window = ReportWindow.of("2024-02-01 00:00:00", "2024-03-15 23:59:59")
    left = _left(spark)
    got = join_in_range(left, views, window, chunk_rows=100)
    assert sorted(map(str, map(tuple, got.collect()))) == _brute(left, views, lambda r: (window.lo, window.hi))
    with pytest.raises(ValueError, match="created_at"):
        join_in_range(left.withColumn("created_at", F.lit(1)), views, window)
    assert join_in_range(left.limit(0), views, ("since", "since")).count() == 0


def test_measured_bounds_prune_stored_months(spark, views, tmp_path):
    write_by_month(views, f"{tmp_path}/views", tie="website_pageview_id")
    stored = spark.read.parquet(f"{tmp_path}/views")
    left = spark.createDataFrame([(HOT, dt.datetime(2024, 2, 10), 60)], "website_session_id long, since timestamp_ntz, minutes int")
    for month in glob.glob(f"{tmp_path}/views/*=2024-0[134]*/*.parquet"):  # months out of reach: reading them would fail
        with open(month, "wb") as f:
            f.write(b"not a parquet file")
    got = join_in_range(left, stored, ("since", "since + make_dt_interval(0, 0, minutes)"))
    assert {tuple(r) for r in got.collect()} == {
        (HOT, dt.datetime(2024, 2, 10), 60, v.website_pageview_id, v.created_at, v.pageview_url)
        for v in views.collect_rows
        if v.website_session_id == HOT and v.created_at and dt.datetime(2024, 2, 10) <= v.created_at <= dt.datetime(2024, 2, 10, 1)
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "created_month__" in line]
    assert scans and all("trunc(cast(" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in scans)


def test_hot_session_is_split(spark, views):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k) for k in (key, threshold)}
    spark.conf.set(key, "false")
    spark.conf.set(threshold, "-1")
    try:
        assert [tuple(r) for r in hot_sessions(views, 256).collect()] == [(HOT, 2501)]
        joined = join_in_range(_left(spark), views, ("since", "since + INTERVAL '30' DAY"), chunk_rows=256)
        tagged = joined.select("*", F.spark_partition_id().alias("__p")).filter(f"website_session_id = {HOT}")
        per_task = tagged.groupBy("__p").agg(F.count("*").alias("n"), *[F.max(c) for c in joined.columns]).collect()
        assert len(per_task) > 2 and max(r.n for r in per_task) < sum(r.n for r in per_task) * 0.7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
