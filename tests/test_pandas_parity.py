"""The notebook's operators against pandas itself, on CSV files written the way pandas writes them."""

from __future__ import annotations

import os

import pandas as pd

from trailscope import ReportWindow, Segment, bounce_rate, conversion_report, master_table, read_mart, write_mart
from trailscope.operators import quality
from trailscope.session import shared_path
from trailscope.sources.csv_io import read_csv
from trailscope.sources.schemas import SESSIONS
from trailscope.sources.tables import read_csv_tables
from tests.edge_fixture import ORDER_ROWS, PAGEVIEW_ROWS, SESSION_ROWS, edge_tables

CASE1 = ReportWindow.of("2012-03-19 00:00:00", "2012-04-30 23:59:59")
MART = ReportWindow.of("2012-03-19 00:00:00", "2012-12-31 23:59:59")


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _write_exports(spark) -> dict[str, str]:
    """The three tables as single CSV files from pandas ``to_csv(index=False)``, with NA tokens."""
    root = _local(shared_path(spark, "pandas_exports"))
    os.makedirs(root, exist_ok=True)
    cols = ["website_session_id", "created_at", "user_id", "is_repeat_session", "utm_source", "utm_campaign",
            "utm_content", "device_type", "http_referer"]
    rows = []
    for i, (sid, ts, user, rep, src, camp, dev) in enumerate(SESSION_ROWS):
        content = None if src is None else "g_ad_1"
        referer = "NULL" if src is None else f"https://www.{src}.com"  # a token pandas reads as missing
        rows.append((sid, ts, user, rep, src if src is not None else ("NA" if i % 2 else None), camp, content, dev, referer))
    pd.DataFrame(rows, columns=cols).to_csv(f"{root}/website_sessions.csv", index=False)
    pd.DataFrame(PAGEVIEW_ROWS, columns=["website_pageview_id", "created_at", "website_session_id", "pageview_url"]).to_csv(
        f"{root}/website_pageviews.csv", index=False
    )
    pd.DataFrame(
        [(s, n, str(p), str(c)) for s, n, p, c in ORDER_ROWS],
        columns=["website_session_id", "items_purchased", "price_usd", "cogs_usd"],
    ).to_csv(f"{root}/orders.csv", index=False)
    return {t: f"{root}/{t}.csv" for t in ("website_sessions", "website_pageviews", "orders")}


def test_null_profile_and_fill_match_pandas(spark):
    paths = _write_exports(spark)
    pdf = pd.read_csv(paths["website_sessions"])
    sdf = read_csv(spark, paths["website_sessions"], SESSIONS)
    ours = {r.column_name: r.null_count for r in quality.null_profile(sdf).collect()}
    assert ours == {c: int(n) for c, n in pdf.isnull().sum().items()}
    filled = pdf.copy()
    for c, v in quality.DEFAULT_FILLS.items():
        filled[c] = filled[c].fillna(v)
    after = {r.column_name: r.null_count for r in quality.null_profile(quality.fill_nulls(sdf)).collect()}
    assert after == {c: int(n) for c, n in filled.isnull().sum().items()}


def test_duplicates_match_pandas(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "x", None), (2, "x", None), (2, "x", None), (3, "y", "b")]
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    sdf = spark.createDataFrame(rows, "a long, b string, c string")
    want = sorted(tuple(None if pd.isna(v) else v for v in r) for r in pdf[pdf.duplicated()].itertuples(index=False))
    got = sorted(tuple(r) for r in quality.duplicate_rows(sdf).collect())
    assert got == want


def test_reports_from_csv_exports_equal_in_memory_fixture(spark):
    paths = _write_exports(spark)
    raw = read_csv_tables(spark, paths["website_sessions"], paths["website_pageviews"], paths["orders"])
    tables = raw._replace(sessions=quality.fill_nulls(raw.sessions))
    edge = edge_tables(spark)
    gn = Segment("gsearch", "nonbrand")
    assert conversion_report(tables, CASE1).collect() == conversion_report(edge, CASE1).collect()
    assert bounce_rate(tables, CASE1, ("/home",), gn).collect() == bounce_rate(edge, CASE1, ("/home",), gn).collect()


def test_mart_write_and_read_back(spark):
    edge = edge_tables(spark)
    path = shared_path(spark, "marts_test/master_table")
    mart = master_table(edge, MART)
    write_mart(mart, path)
    write_mart(mart, path)  # drop-and-recreate: a second build replaces the first
    back = read_mart(spark, path)
    assert back.count() == 11
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mart.collect()))


def test_half_open_window(spark):
    edge = edge_tables(spark)
    closed = ReportWindow.of("2012-03-19 00:00:00", "2012-04-29 23:59:59")
    half_open = ReportWindow.of("2012-03-19 00:00:00", "2012-04-30 00:00:00", half_open=True)
    n_closed = edge.sessions.filter(closed.contains("created_at")).count()
    n_open = edge.sessions.filter(half_open.contains("created_at")).count()
    assert (n_closed, n_open) == (3, 4)  # session 3 at 23:59:59.5 falls only in the half-open window


def test_build_marts_writes_both_tables(spark):
    from trailscope import build_marts

    edge = edge_tables(spark)
    master, chains = shared_path(spark, "marts_test/master"), shared_path(spark, "marts_test/funnel")
    build_marts(edge, MART, ReportWindow.of("2012-03-01 00:00:00", "2012-12-31 23:59:59"), master, chains)
    assert read_mart(spark, master).count() == 11 and read_mart(spark, chains).count() == 20


def test_command_line_runs_every_case(spark):
    from trailscope.__main__ import main

    paths = _write_exports(spark)
    out = shared_path(spark, "cli_out")
    written = main(
        ["--sessions", paths["website_sessions"], "--pageviews", paths["website_pageviews"],
         "--orders", paths["orders"], "--out", out]
    )
    assert len(written) == 19
    assert spark.read.parquet(written["bounce_rate"]).collect()[0].total_sessions == 4
    assert read_mart(spark, written["master_table"]).count() == 11


def test_stored_layout_gives_the_same_reports(spark):
    from trailscope.plans.cases import case_reports
    from trailscope.sources.tables import store_tables

    edge = edge_tables(spark)
    stored = store_tables(spark, edge, shared_path(spark, "edge_store"), 4, "trailscope_edge_store")
    assert stored.order_facts is not None and "trailscope_created_month__" in stored.pageviews.columns
    got, want = case_reports(stored), case_reports(edge)
    for name in want:
        a = sorted(map(tuple, got[name].collect()), key=repr)
        b = sorted(map(tuple, want[name].collect()), key=repr)
        assert a == b, name


def test_command_line_writes_the_checks_and_the_cleaned_tables(spark):
    import pandas as pd

    from trailscope.__main__ import main
    from trailscope.sources.csv_io import read_csv

    paths = _write_exports(spark)
    out = shared_path(spark, "cli_quality")
    main(["--sessions", paths["website_sessions"], "--pageviews", paths["website_pageviews"], "--orders", paths["orders"], "--out", out, "--format", "csv"])
    raw = {k: read_csv(spark, p).toPandas() for k, p in paths.items()}
    summary = {r.table_name: r for r in read_csv(spark, f"{out}/quality/summary", infer=True).collect()}
    for table, name in (("sessions", "website_sessions"), ("pageviews", "website_pageviews"), ("orders", "orders")):
        frame = raw[name]
        assert summary[table].total_rows == len(frame) and summary[table].nulls_before == int(frame.isnull().sum().sum())
        nulls = {r.column_name: r.null_count for r in read_csv(spark, f"{out}/quality/{table}_nulls", infer=True).collect()}
        assert nulls == frame.isnull().sum().to_dict()
    fills = {"utm_source": "direct", "utm_campaign": "noncampaign", "utm_content": "noncontent", "http_referer": "nonreferer"}
    filled = raw["website_sessions"].fillna(fills).sort_values("website_session_id").astype(object)
    cleaned = read_csv(spark, f"{out}/cleaned/cleaned_website_sessions").toPandas().sort_values("website_session_id").astype(object)
    # The exported cells equal the input text, times included.
    assert cleaned[sorted(filled.columns)].where(pd.notna, None).values.tolist() == filled[sorted(filled.columns)].where(pd.notna, None).values.tolist()
    assert summary["sessions"].nulls_after == int(filled.isnull().sum().sum())
    assert spark.read.option("header", True).csv(f"{out}/reports/bounce_rate").first().total_sessions == "4"
