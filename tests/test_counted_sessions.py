"""Counted session tables, distributed row numbers, bitmaps of ids, published marts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import rows_of
from tests.test_random_differential import REPORTS, random_tables
from trailscope.functions.params import COPIES, ReportWindow, WebTables
from trailscope.operators.numbering import number_rows
from trailscope.operators.quality import count_copies, duplicate_rows, duplicate_summary, expand_copies, null_profile
from trailscope.operators.rollup import distinct_counts
from trailscope.plans.conversion import conversion_report
from trailscope.plans.marts import build_marts, drop_mart, publish_mart, read_mart, write_mart
from trailscope.session import list_folders
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS
from trailscope.sources.tables import store_tables


def _tables(spark, seed: int) -> WebTables:
    sessions, pageviews, orders = random_tables(seed, True)
    return WebTables(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(pageviews, PAGEVIEWS), spark.createDataFrame(orders, ORDERS))


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_reports_are_equal_over_counted_sessions(spark):
    plain = _tables(spark, 31)
    counted = plain._replace(sessions=count_copies(plain.sessions))
    assert counted.sessions.count() < plain.sessions.count() and counted.sessions.filter(f"{COPIES} > 1").count() > 0
    for name, build in REPORTS.items():
        assert _rows(build(counted)) == _rows(build(plain)), name
    for report in (null_profile, duplicate_rows, duplicate_summary):
        assert _rows(report(counted.sessions)) == _rows(report(plain.sessions))
    assert _rows(expand_copies(counted.sessions)) == _rows(plain.sessions)


def test_a_repeated_session_row_is_one_stored_row(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 2, 10, 0)
    hot = (7, t0, 1, 0, "gsearch", "nonbrand", None, "desktop", "r")
    sessions = spark.createDataFrame([hot] * 3000 + [(k, t0, k, 0, "bsearch", "brand", "x", "mobile", "r") for k in range(100, 400)], SESSIONS).repartition(6)
    pageviews = spark.createDataFrame([(1, t0, 7, "/home"), (2, t0, 100, "/home")], PAGEVIEWS)
    orders = spark.createDataFrame([], ORDERS)
    stored = store_tables(spark, WebTables(sessions, pageviews, orders), f"{tmp_path}/t", 4, "counted_sessions_test")
    assert stored.sessions.count() == 301
    assert [r[COPIES] for r in stored.sessions.filter("website_session_id = 7").collect()] == [3000]
    report = {r.utm_source: r.total_sessions for r in conversion_report(stored, ReportWindow.of("2024-01-01", "2024-01-31")).collect()}
    assert report == {"gsearch": 3000, "bsearch": 300}
    for table in ("sessions", "order_facts"):
        spark.sql(f"DROP TABLE counted_sessions_test_{table}")


def test_numbers_equal_row_number(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["a", "b", None]), rng.randrange(50)) for _ in range(500)] + [(1, "a", 3)] * 700
    df = spark.createDataFrame(rows, "k int, s string, `odd name` int").repartition(5)
    order = [F.col("k").desc_nulls_first(), F.col("s").asc_nulls_last(), F.col("odd name").asc()]
    got = number_rows(df, order, "n")
    assert sorted(r.n for r in got.collect()) == list(range(1, len(rows) + 1))
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= len(rows)

    def key(r):
        return (r[0] is not None, -(r[0] or 0), r[1] is None, r[1] or "", r[2])

    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r.n)] == sorted(rows, key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert number_rows(df.limit(0), order, "n").count() == 0
    with pytest.raises(ValueError, match="taken"):
        number_rows(df, order, "s")


def test_ties_of_the_sort_key_are_spread(spark):
    df = spark.range(4000).selectExpr("1 AS k", "id").repartition(4)
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "false")
        spark.conf.set(keys[1], "4k")
        spark.conf.set(keys[2], "1")
        got = number_rows(df, [F.col("k").asc()], "n")
        per_task = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.max("n"), F.max("id")).collect()
        assert len(per_task) > 3 and max(r.c for r in per_task) < 2500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bitmap_counts_equal_distinct_counts(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([rng.randrange(100_000), rng.randrange(-40_000, 5), None, 32768, 32769, 0])) for _ in range(5000)] + [("a", 77)] * 5000
    df = spark.createDataFrame(rows, "g string, website_session_id long").repartition(4)
    want = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("website_session_id").alias("n")).collect()}
    assert {r.g: r.sessions for r in distinct_counts(df, "g").collect()} == want


def test_published_mart_is_replaced_in_one_step(spark, tmp_path):
    root = f"{tmp_path}/mart"
    publish_mart(spark.range(5), "published_test", root=root)
    assert spark.table("published_test").count() == 5
    reader = spark.table("published_test")  # planned on the first version
    publish_mart(spark.range(7).selectExpr("id", "id * 2 AS twice"), "published_test", root=root, sort_within=("id",))
    assert sorted(r.twice for r in read_mart(spark, "published_test").collect()) == [0, 2, 4, 6, 8, 10, 12]
    assert reader.count() == 5
    with pytest.raises(Exception, match="boom"):
        publish_mart(spark.range(9).selectExpr("IF(id = 8, raise_error('boom'), id) AS id"), "published_test", root=root)
    assert spark.table("published_test").columns == ["id", "twice"] and spark.table("published_test").count() == 7
    assert len(list_folders(spark, root)) == 2  # this version and the one before; nothing of the failed one
    publish_mart(spark.table("published_test").limit(3), "published_test", root=root)  # a mart built from itself
    assert spark.table("published_test").count() == 3 and len(list_folders(spark, root)) == 2
    drop_mart(spark, "published_test", root)
    drop_mart(spark, "published_test", root)
    assert not spark.catalog.tableExists("published_test")
    spark.range(1).write.saveAsTable("plain_table_test")
    with pytest.raises(ValueError, match="drop it first"):
        publish_mart(spark.range(2), "plain_table_test", root=root)
    spark.sql("DROP TABLE plain_table_test")


def test_failed_rebuild_of_a_path_keeps_the_old_mart(spark, tmp_path):
    path = f"{tmp_path}/mart"
    write_mart(spark.range(4), path)
    with pytest.raises(Exception, match="boom"):
        write_mart(spark.range(9).selectExpr("IF(id = 8, raise_error('boom'), id) AS id"), path)
    assert read_mart(spark, path).count() == 4
    write_mart(read_mart(spark, path).limit(2), path)
    assert read_mart(spark, path).count() == 2 and list_folders(spark, str(tmp_path)) == ["mart"]


def test_marts_by_name(spark):
    tables = _tables(spark, 32)
    window = ReportWindow.of("2024-01-01 00:00:00", "2024-01-28 23:59:59")
    for _ in range(2):
        build_marts(tables, window, window, "master_by_name", "chains_by_name")
    assert read_mart(spark, "master_by_name").count() > 0 and read_mart(spark, "chains_by_name").count() > 0
    for name in ("master_by_name", "chains_by_name"):
        drop_mart(spark, name)
