"""Run the whole analysis from the command line.

    python -m trailscope --sessions S.csv --pageviews P.csv --orders O.csv --out DIR [--format parquet|csv] [--no-store] [--no-quality]

Reads the three CSV exports (pandas null tokens read as NULL, columns outside the
schemas typed by their cells), writes the checks of the cleaning flow to ``DIR/quality``
and the cleaned tables to ``DIR/cleaned`` (CSV), stores the cleaned tables under ``DIR/tables`` in the layout the
reports are planned for, writes every report of the four business cases to ``DIR/reports/<name>``
and rebuilds the two dashboard tables under ``DIR/marts/``. Uses the active
Spark session, or creates one with the cluster's defaults.
"""

from __future__ import annotations

import argparse
import hashlib

from pyspark.sql import SparkSession

from trailscope.plans.cases import FUNNEL_TABLE, MASTER_TABLE, case_reports
from trailscope.plans.cleaning import clean_tables, export_cleaned, quality_report, quality_summary, write_quality
from trailscope.plans.marts import build_marts
from trailscope.sources.csv_io import write_csv
from trailscope.sources.tables import read_csv_tables, store_tables

MARTS = ("master_table", "funnel_table")


def main(argv: list[str] | None = None) -> dict[str, str]:
    parser = argparse.ArgumentParser(prog="trailscope", description=__doc__.split("\n\n")[0])
    parser.add_argument("--sessions", required=True, help="website sessions CSV (file or folder, with header)")
    parser.add_argument("--pageviews", required=True, help="website page views CSV")
    parser.add_argument("--orders", required=True, help="orders CSV")
    parser.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet", help="format of the reports")
    parser.add_argument(
        "--store",
        action=argparse.BooleanOptionalAction,
        default=True,
        help="store the cleaned tables under DIR/tables, so that each report does not parse the CSV files again",
    )
    parser.add_argument(
        "--quality", action=argparse.BooleanOptionalAction, default=True, help="write the checks of the cleaning flow and the cleaned tables"
    )
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("trailscope").getOrCreate()
    raw = read_csv_tables(spark, args.sessions, args.pageviews, args.orders, infer=args.quality)
    tables, out = clean_tables(raw), args.out.rstrip("/")
    if args.quality:
        write_quality(quality_report(raw), quality_summary(raw), f"{out}/quality")
        export_cleaned(tables, f"{out}/cleaned")
    if args.store:
        prefix = "trailscope_" + hashlib.sha1(out.encode()).hexdigest()[:10]
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = store_tables(spark, tables, f"{out}/tables", buckets, prefix)
    written = {}
    for name, report in case_reports(tables, ordered=True).items():
        if name in MARTS:
            continue
        path = f"{out}/reports/{name}"
        if args.format == "csv":
            write_csv(report, path)
        else:
            report.write.mode("overwrite").parquet(path)
        written[name] = path
    build_marts(tables, MASTER_TABLE, FUNNEL_TABLE, f"{out}/marts/master_table", f"{out}/marts/funnel_table")
    written.update({m: f"{out}/marts/{m}" for m in MARTS})
    return written


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}\t{path}")
