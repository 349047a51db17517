"""Data-quality operators: profile, fill, duplicates, CSV null tokens (FIXTURES.md section 4)."""

from __future__ import annotations

import os

from pyspark.sql import types as T

from trailscope.operators import quality
from trailscope.session import shared_path
from trailscope.sources.csv_io import read_csv, write_csv
from trailscope.sources.schemas import SESSIONS
from tests.edge_fixture import raw_edge_tables


def test_duplicates_nulls_compare_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    dups = quality.duplicate_rows(df).collect()
    assert sorted(tuple(r) for r in dups) == [(1, None), (1, None)]
    summary = quality.duplicate_summary(df).collect()[0]
    assert (summary.total_rows, summary.distinct_rows, summary.duplicate_rows) == (4, 2, 2)


def test_duplicates_hot_group_spread(spark):
    # One group of copies is most of the table; the chunked expansion still emits every copy.
    rows = [(7, "hot")] * 25 + [(1, "a"), (1, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "a int, b string")
    from trailscope.operators.expand import replicate_rows

    groups = quality.duplicate_groups(df)
    out = replicate_rows(groups, "__dup_n - 1", chunk_rows=4).drop("__dup_n").collect()
    assert sorted(tuple(r) for r in out) == [(1, "a")] + [(7, "hot")] * 24


def test_null_profile_fill_and_recheck(spark):
    raw = raw_edge_tables(spark).sessions
    before = {r.column_name: r.null_count for r in quality.null_profile(raw).collect()}
    assert before["utm_source"] == 1 and before["utm_campaign"] == 1 and before["http_referer"] == 1
    report = quality.clean_sessions(raw)
    after = {r.column_name: r.null_count for r in report.nulls_after.collect()}
    assert set(after.values()) == {0}
    s4 = report.cleaned.filter("website_session_id = 4").collect()[0]
    assert (s4.utm_source, s4.utm_campaign, s4.utm_content, s4.http_referer) == (
        "direct",
        "noncampaign",
        "noncontent",
        "nonreferer",
    )
    assert [r.website_session_id for r in report.null_rows_before.collect()] == [4]
    assert report.duplicates.count() == 0


def test_duplicates_are_tested_after_the_fill(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("utm_source", T.StringType())])
    df = spark.createDataFrame([(1, None), (1, "direct")], schema)
    assert quality.duplicate_rows(df).count() == 0
    assert quality.duplicate_rows(quality.fill_nulls(df)).collect()[0].utm_source == "direct"


def test_head_is_ordered_by_key(spark):
    raw = raw_edge_tables(spark).sessions
    assert [r.website_session_id for r in quality.head(raw, 3, ["website_session_id"]).collect()] == [1, 2, 3]


def test_csv_null_tokens_follow_pandas(spark):
    path = shared_path(spark, "csv_tokens")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    with open(os.path.join(path.replace("file:", ""), "part.csv"), "w") as f:
        f.write("id,a,b\n1,,NULL\n2,NA,\"\"\n3,x,\"he said \"\"hi\"\"\"\n")
    df = read_csv(spark, path)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("1", None, None), ("2", None, None), ("3", "x", 'he said "hi"')]


def test_csv_roundtrip_keeps_types_and_nulls(spark):
    raw = raw_edge_tables(spark).sessions
    path = shared_path(spark, "csv_roundtrip_test")
    write_csv(raw, path)
    back = read_csv(spark, path, SESSIONS)
    assert back.schema == SESSIONS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))


def test_notebook_flow_report_and_export(spark):
    from trailscope.plans.cleaning import export_cleaned, quality_report
    from trailscope.sources.tables import read_csv_tables

    raw = raw_edge_tables(spark)
    report = quality_report(raw)
    assert {r.column_name: r.null_count for r in report.nulls["sessions"].collect()}["utm_source"] == 1
    assert all(r.null_count == 0 for r in report.nulls["pageviews"].collect())
    assert [r.website_session_id for r in report.missing_source.collect()] == [4]
    assert all(r.null_count == 0 for r in report.nulls_after_fill.collect())
    assert all(df.count() == 0 for df in report.duplicates.values())
    paths = export_cleaned(report.cleaned, shared_path(spark, "exports"))
    back = read_csv_tables(spark, paths["sessions"], paths["pageviews"], paths["orders"])
    for name in ("sessions", "pageviews", "orders"):
        got, want = getattr(back, name), getattr(report.cleaned, name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_csv_binds_columns_by_name_and_keeps_extras(spark):
    import os

    path = shared_path(spark, "csv_reordered")
    local = path.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "part.csv"), "w") as f:
        f.write("device_type,extra,website_session_id,utm_source,created_at,user_id,is_repeat_session,"
                "utm_campaign,utm_content,http_referer\n")
        f.write("mobile,x1,7,gsearch,2012-03-19 00:00:00,3,0,nonbrand,,NA\n")
    df = read_csv(spark, path, SESSIONS)
    assert df.columns == SESSIONS.fieldNames() + ["extra"]
    r = df.collect()[0]
    assert (r.website_session_id, r.user_id, r.device_type, r.utm_content, r.http_referer, r.extra) == (
        7, 3, "mobile", None, None, "x1")
