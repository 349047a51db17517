"""One hot key with a large share of the rows: results stay exact and the hot key's work is spread."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from trailscope.functions.params import ReportWindow, WebTables
from trailscope.functions.steps import DEFAULT_STEPS
from trailscope.operators.chains import funnel_chains
from trailscope.operators.expand import replicate_rows
from trailscope import registry
from trailscope.operators.ranking import PID, entry_pages, first_pages, leading_pages, rank_pages, rank_pages_plain
from trailscope.plans.conversion import conversion_report
from trailscope.plans.marts import master_table
from trailscope.sources.schemas import ORDERS, PAGEVIEWS, SESSIONS

HOT = 999
FUNNEL = list(DEFAULT_STEPS)


@pytest.fixture(autouse=True)
def no_coalescing(spark):
    """Tiny test data would be coalesced into one partition; at scale partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def hot_pageviews(spark, n_hot: int = 3000, n_cold: int = 300):
    """Session ``HOT`` holds most page views, walking the funnel over and over."""
    rng = random.Random(5)
    rows = []
    for i in range(n_hot):
        rows.append((i * 3, HOT, FUNNEL[i % len(FUNNEL)] if rng.random() < 0.9 else "/other"))
    for j in range(n_cold):
        rows.append((j * 3 + 1, j % 50, FUNNEL[j % 4]))
    return spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string")


def partitions_of(df, sid: int = HOT) -> int:
    """Tasks holding the hot session's output rows (tagged before filtering, so the
    filter cannot move below the last shuffle)."""
    tagged = df.select("*", F.spark_partition_id().alias("__p"))
    # Aggregate every column and collect (``count()`` would let Spark prune them), so
    # column pruning cannot drop the operator under test. One row per task.
    per_task = tagged.filter(f"website_session_id = {sid}").groupBy("__p").agg(*[F.max(c) for c in df.columns])
    return len(per_task.collect())


def test_chunked_rank_spreads_a_hot_session(spark):
    pv = hot_pageviews(spark)
    ranked = rank_pages(pv, chunk_rows=256)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, rank_pages_plain(pv).collect()))
    assert partitions_of(ranked) > 1  # the plain window puts the whole session in one task
    assert partitions_of(rank_pages_plain(pv)) == 1


def test_chain_window_spreads_a_hot_session(spark):
    chains = funnel_chains(rank_pages(hot_pageviews(spark), chunk_rows=256))
    assert chains.filter(f"website_session_id = {HOT}").count() > 100
    assert partitions_of(chains) > 1


def test_replication_spreads_a_hot_row(spark):
    df = spark.createDataFrame([(HOT, 50_000), (1, 2), (2, 1)], "website_session_id long, n long")
    out = replicate_rows(df, "n", chunk_rows=1000)
    counts = {r.website_session_id: r["count"] for r in out.groupBy("website_session_id").count().collect()}
    assert counts == {HOT: 50_000, 1: 2, 2: 1}
    assert partitions_of(out) > 1


def test_reports_exact_with_a_hot_ordering_session(spark):
    import datetime as dt
    from decimal import Decimal

    t0 = dt.datetime(2024, 1, 2, 10, 0)
    sessions = spark.createDataFrame(
        [(HOT, t0, 1, 0, "gsearch", "nonbrand", "x", "desktop", "r"), (2, t0, 2, 0, "bsearch", "brand", "x", "mobile", "r")],
        SESSIONS,
    )
    pageviews = spark.createDataFrame([(1, t0, HOT, "/home"), (2, t0, 2, "/home")], PAGEVIEWS)
    orders = spark.createDataFrame([(HOT, 1, Decimal("1.00"), Decimal("0.40"))] * 4000 + [(2, 2, Decimal("5.00"), Decimal("2.00"))], ORDERS)
    tables = WebTables(sessions, pageviews, orders)
    window = ReportWindow.of("2024-01-01 00:00:00", "2024-01-31 23:59:59")
    rep = {r.utm_source: (r.total_sessions, r.total_orders, str(r.total_sales)) for r in conversion_report(tables, window).collect()}
    assert rep == {"gsearch": (4000, 4000, "4000.00"), "bsearch": (1, 1, "10.00")}
    from trailscope.operators import expand

    # The master table has one row per order of the hot session, built in chunks of at most 500 copies.
    original = expand.DEFAULT_CHUNK_ROWS
    expand.DEFAULT_CHUNK_ROWS = 500
    try:
        mart = master_table(tables, window)
        assert mart.filter(f"website_session_id = {HOT}").count() == 4000
        assert partitions_of(mart) > 1
    finally:
        expand.DEFAULT_CHUNK_ROWS = original


def test_rank_of_sparse_ids(spark):
    """Ids far apart give no more parts than dense ones, and the same ranks."""
    dense = hot_pageviews(spark)
    sparse = dense.withColumn("website_pageview_id", F.expr("website_pageview_id * 4194304L * 65536L"))
    ranked = rank_pages(sparse, chunk_rows=256)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, rank_pages_plain(sparse).collect()))
    assert 1 < partitions_of(ranked)


def test_rank_of_crowded_and_repeated_ids(spark):
    """All but a few ids of the hot session in one narrow range, with ties, a repeated view and views without an id."""
    rng = random.Random(9)
    rows = [(rng.randrange(2000), HOT, rng.choice(FUNNEL)) for _ in range(3000)] + [(1 << 60, HOT, "/cart"), (-(1 << 60), HOT, "/home")]
    rows += [rows[5]] * 700 + [(None, HOT, "/home")] * 3 + [(k, k % 40, "/home") for k in range(300)] + [(1, None, "/home")]
    pv = spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string").repartition(5)
    ranked = rank_pages(pv, chunk_rows=128)
    assert sorted(map(str, map(tuple, ranked.collect()))) == sorted(map(str, map(tuple, rank_pages_plain(pv).collect())))
    assert partitions_of(ranked) > 3
    few = leading_pages(pv.filter(f"{PID} IS NOT NULL"), 7, rank_col="r")
    want = first_pages(pv.filter(f"{PID} IS NOT NULL"), 7, "r").groupBy("website_session_id", F.col("pageview_url").alias("page"), "r").count()
    got = few.groupBy("website_session_id", "page", "r").agg(F.sum("n_views"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_entry_pages_fold_repeated_views(spark):
    """A first page view that holds most rows is one row per map task before the sessions are brought together."""
    rows = [(1, HOT, "/home")] * 5000 + [(2, HOT, "/products"), (3, 1, "/home"), (4, 1, "/cart"), (None, 2, "/cart")]
    pv = spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string").repartition(4)
    found = {}
    for r in entry_pages(pv, 2).collect():
        key = (r.website_session_id, r.rank_page if r.page == "/home" else 0, r.page)
        found[key] = found.get(key, 0) + r.n_views
    assert found[(HOT, 1, "/home")] == 5000 and found[(1, 1, "/home")] == 1 and found[(2, 0, "/cart")] == 1
    assert entry_pages(pv).filter(f"website_session_id = {HOT}").count() <= 4


def test_segment_semi_join_shuffles_bucketed_sessions(spark):
    """Both sides of the join of raw page views must be shuffled, else adaptive execution can't split a hot session."""
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("driver data not present")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.q_semi_join_segment(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ENSURE_REQUIREMENTS") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chain_window_reshuffles_input_partitioned_by_session(spark):
    # Input partitioned by session alone must not satisfy the (session, diagonal) window.
    pv = hot_pageviews(spark)
    from_plain = funnel_chains(rank_pages_plain(pv))
    from_chunked = funnel_chains(rank_pages(pv, chunk_rows=256))
    assert sorted(map(tuple, from_plain.collect())) == sorted(map(tuple, from_chunked.collect()))
    assert partitions_of(from_plain) > 1


def test_task_metrics_from_event_log():
    """Largest task (shuffle records read) from Spark's event log, in a separate Spark process."""
    import json
    import os
    import subprocess
    import sys
    import tempfile

    scratch = tempfile.mkdtemp(prefix="trailscope-skew-", dir="/tmp")
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "skew_tasks.py")
    out = subprocess.run([sys.executable, script, scratch], capture_output=True, text=True, timeout=600, check=True)
    worst = json.loads(out.stdout.strip().splitlines()[-1])
    assert worst["plain"] >= worst["hot_rows"]  # the plain window reads the whole hot session in one task
    assert worst["chunked"] < worst["hot_rows"] / 2  # the chunked rank spreads it
    # A page view repeated over most rows: folded by each map task, never together in one. Its copies are expanded in the last, shuffle-free step.
    assert worst["copies_rank"] < worst["hot_rows"] / 4 and worst["copies_chains"] < worst["hot_rows"] / 4
    assert worst["copies_pairs"] < worst["hot_rows"] / 4
    assert worst["copies_funnel"] < worst["hot_rows"] / 2  # one share for each of 8 map tasks; some share one of the 8 partitions
    assert worst["crowded"] < worst["hot_rows"] / 2  # equal id ranges would put all but one of the session's rows into one range
    assert worst["rollup"] < 100  # the rollup folds the hot session map-side: a few partial rows per task
    assert worst["explode"] >= worst["hot_copies"]  # a plain explode writes every copy from one task
    assert worst["replicate"] <= worst["hot_copies"] / 2  # salted replication spreads them
