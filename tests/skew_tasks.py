"""Largest task of the plain and the chunked page rank, read from Spark's event log.

Usage: ``python tests/skew_tasks.py <scratch dir>``; prints one JSON line
``{"plain": ..., "chunked": ..., "rollup": ..., "hot_rows": n}`` where a value
is the most shuffle records any single task of that job read (the plain and
the chunked page rank, rank and chains over a page view that is repeated and over crowded ids, the per-session rollup) or wrote to files (copies of a
hot row: a plain explode and the salted replication).
"""

from __future__ import annotations

import glob
import json
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HOT_ROWS = 6000
HOT_COPIES = 50_000


def run(scratch: str) -> dict[str, int]:
    from pyspark.sql import SparkSession

    from trailscope.functions.params import ReportWindow, WebTables
    from trailscope.operators.chains import successor_pairs
    from trailscope.operators.ranking import over_ranks, rank_pages, rank_pages_plain
    from trailscope.plans.funnel import funnel_report, funnel_table
    from trailscope.operators.expand import replicate_rows
    from trailscope.operators.rollup import session_rollup

    logs = os.path.join(scratch, "events")
    os.makedirs(logs, exist_ok=True)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", logs)
        .config("spark.eventLog.compress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep partitions apart, as at scale
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = [(i * 3, 999, "/home") for i in range(HOT_ROWS)] + [(i * 3 + 1, i % 60, "/cart") for i in range(600)]
    pv = spark.createDataFrame(rows, "website_pageview_id long, website_session_id long, pageview_url string")
    pv = pv.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, website_pageview_id) AS created_at")
    # One page view that is repeated, and a hot session whose ids crowd into one range beside a far one.
    view = "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS created_at"
    copies = spark.createDataFrame([(7, 999, "/home")] * HOT_ROWS + rows[HOT_ROWS:], pv.drop("created_at").schema).repartition(8).selectExpr("*", view)
    crowded = spark.createDataFrame([(k, s, u) for k, s, u in rows] + [(1 << 60, 999, "/cart")], pv.drop("created_at").schema)
    window = ReportWindow.of("2024-01-01", "2024-01-31")
    tables = WebTables(copies, copies, copies)
    jobs = (
        ("copies_rank", rank_pages(copies, chunk_rows=512)),
        ("copies_chains", funnel_table(tables, window, chunk_rows=512)),
        ("copies_pairs", over_ranks(copies, successor_pairs, chunk_rows=512)),
        ("copies_funnel", funnel_report(tables, window)),
        ("crowded", rank_pages(crowded, chunk_rows=512)),
        ("plain", rank_pages_plain(pv)),
        ("chunked", rank_pages(pv, chunk_rows=512)),
        ("rollup", session_rollup(pv, flag_pages=("/home",))),
    )
    for name, df in jobs:
        spark.sparkContext.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
    # Copies of one hot row, written to files: records written per task.
    counts = spark.createDataFrame([(999, HOT_COPIES)] + [(k, 2) for k in range(40)], "k long, n long")
    for name, df in (
        ("explode", counts.selectExpr("k", "explode(sequence(1L, n)) AS i").drop("i")),
        ("replicate", replicate_rows(counts, "n", chunk_rows=1000)),
    ):
        spark.sparkContext.setJobGroup(name, name)
        df.write.mode("overwrite").parquet(os.path.join(scratch, name))
    spark.stop()

    job_group, stage_group, worst = {}, {}, dict.fromkeys([name for name, _ in jobs] + ["explode", "replicate"], 0)
    for path in sorted(glob.glob(os.path.join(logs, "**", "events_*"), recursive=True)):  # rolling log files
        with open(path) as f:
            for line in f:
                event = json.loads(line)
                kind = event.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                    for stage in event.get("Stage IDs", []):
                        stage_group[stage] = group
                    job_group[event["Job ID"]] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(event.get("Stage ID"))
                    metrics = event.get("Task Metrics") or {}
                    read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    written = (metrics.get("Output Metrics") or {}).get("Records Written", 0)
                    if group in worst:
                        worst[group] = max(worst[group], written if group in ("explode", "replicate") else read)
    return {**worst, "hot_rows": HOT_ROWS, "hot_copies": HOT_COPIES}


if __name__ == "__main__":
    print(json.dumps(run(sys.argv[1])))
