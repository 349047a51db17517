"""The cleaning notebook as one plan: profile, fill, re-check, duplicates, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import TABLE_NAMES, WebTables
from trailscope.operators.quality import duplicate_rows, duplicate_summary, fill_nulls, null_profile, null_rows
from trailscope.sources.csv_io import write_csv

# File names of the cleaned exports.
EXPORT_NAMES = {
    "sessions": "cleaned_website_sessions",
    "pageviews": "cleaned_website_pageviews",
    "orders": "cleaned_orders",
}


@dataclass
class QualityReport:
    """Lazy DataFrames for every check the notebook prints."""

    nulls: dict[str, DataFrame]
    missing_source: DataFrame
    nulls_after_fill: DataFrame
    duplicates: dict[str, DataFrame]
    cleaned: WebTables


def clean_tables(raw: WebTables) -> WebTables:
    """Null fills on sessions (source, campaign, content, referer); the other tables pass through."""
    return raw._replace(sessions=fill_nulls(raw.sessions))


def quality_report(raw: WebTables) -> QualityReport:
    """Null profile of each table, sessions without a source, the profile after the fill,
    and the duplicate rows of each table (sessions tested after the fill, as the notebook does).

    Every check is its own lazy plan; duplicates are reported, never dropped.
    """
    cleaned = clean_tables(raw)
    return QualityReport(
        nulls={name: null_profile(getattr(raw, name)) for name in TABLE_NAMES},
        missing_source=null_rows(raw.sessions, "utm_source"),
        nulls_after_fill=null_profile(cleaned.sessions),
        duplicates={name: duplicate_rows(getattr(cleaned, name)) for name in TABLE_NAMES},
        cleaned=cleaned,
    )


def quality_summary(raw: WebTables) -> DataFrame:
    """The whole cleaning flow in one row per table: ``table_name, total_rows, distinct_rows, duplicate_rows, nulls_before, nulls_after``.

    Profile, fill, re-check, duplicates (of sessions after the fill); ``nulls_*`` are null cells of the table before and after the fill.
    """
    cleaned = clean_tables(raw)
    found = []
    for name in TABLE_NAMES:
        before, after = (null_profile(getattr(t, name)).agg(F.sum("null_count")).scalar() for t in (raw, cleaned))
        counts = duplicate_summary(getattr(cleaned, name))
        found.append(counts.select(F.lit(name).alias("table_name"), "*", before.alias("nulls_before"), after.alias("nulls_after")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def write_quality(report: QualityReport, summary: DataFrame, out_dir: str) -> dict[str, str]:
    """Write every check of the notebook as a CSV directory below ``out_dir``."""
    checks = {"summary": summary, "sessions_missing_source": report.missing_source, "sessions_nulls_after_fill": report.nulls_after_fill}
    checks |= {f"{name}_nulls": df for name, df in report.nulls.items()}
    checks |= {f"{name}_duplicates": df for name, df in report.duplicates.items()}
    paths = {}
    for name, df in checks.items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        write_csv(df, paths[name])
    return paths


def export_cleaned(tables: WebTables, out_dir: str) -> dict[str, str]:
    """Write the cleaned tables as headered CSV directories (NULL as an empty cell)."""
    paths = {}
    for name in TABLE_NAMES:
        paths[name] = f"{out_dir.rstrip('/')}/{EXPORT_NAMES[name]}"
        write_csv(getattr(tables, name), paths[name])
    return paths
