"""Data-quality operators: null profile, null rows, fills, duplicate reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES, count_sql, sql_str
from trailscope.operators.expand import replicate_rows

E = F.expr


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# The notebook's replacements for missing session attributes.
DEFAULT_FILLS = {
    "utm_source": "direct",
    "utm_campaign": "noncampaign",
    "utm_content": "noncontent",
    "http_referer": "nonreferer",
}


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column in long form ``(column_index, column_name, null_count)``.

    One scan with one partial aggregate, then a one-row unpivot. The rows of a counted table (``COPIES``) count as often as they stand for.
    """
    columns = [c for c in df.columns if c != COPIES]
    null = (lambda c: f"count_if({c} IS NULL)") if COPIES not in df.columns else (lambda c: f"coalesce(sum(IF({c} IS NULL, {COPIES}, 0L)), 0L)")
    wide = df.agg(*[E(f"{null(_q(c))} AS c{i}") for i, c in enumerate(columns)])
    rows = ", ".join(
        f"named_struct('column_index', {i}, 'column_name', {sql_str(c)}, 'null_count', c{i})"
        for i, c in enumerate(columns)
    )
    return wide.select(E(f"inline(array({rows}))")).select(
        E("CAST(column_index AS INT) AS column_index"), "column_name", E("CAST(null_count AS BIGINT) AS null_count")
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is NULL."""
    return df.filter(f"{_q(column)} IS NULL")


def head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by a key (Spark has no row order, so a key is required)."""
    keys = order_by or [df.columns[0]]
    return df.orderBy(*keys).limit(n)


def fill_nulls(df: DataFrame, values: dict[str, object] | None = None) -> DataFrame:
    """Per-column null replacement; columns absent from ``df`` are ignored."""
    fills = {c: v for c, v in (values or DEFAULT_FILLS).items() if c in df.columns}
    return df.na.fill(fills) if fills else df


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every distinct full row that occurs more than once, with its count ``n``.

    NULLs compare equal, as in pandas ``duplicated``. A group-by with map-side
    partial counts: a group of copies holding a third of the table is folded to
    one row per map task before the shuffle.
    """
    return _counted(df, "__dup_n").filter("__dup_n > 1")


def _counted(df: DataFrame, name: str) -> DataFrame:
    """Every distinct row with the number of rows it stands for."""
    return df.groupBy(*[_q(c) for c in df.columns if c != COPIES]).agg(E(f"{count_sql(df)} AS {name}"))


def count_copies(df: DataFrame) -> DataFrame:
    """``df`` as a counted table: its distinct rows with their number (``COPIES``). NULLs compare equal."""
    return _counted(df, COPIES)


def expand_copies(df: DataFrame) -> DataFrame:
    """The rows that a counted table stands for; other tables as they are."""
    return replicate_rows(df, COPIES).drop(COPIES) if COPIES in df.columns else df


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The rows ``df.duplicated()`` flags: all copies after the first of each group."""
    groups = duplicate_groups(df)
    return replicate_rows(groups, "__dup_n - 1").drop("__dup_n")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: ``total_rows``, ``distinct_rows``, ``duplicate_rows`` (= total - distinct)."""
    per = _counted(df, "n")
    return per.agg(
        E("CAST(sum(n) AS BIGINT) AS total_rows"),
        E("CAST(count(1) AS BIGINT) AS distinct_rows"),
        E("CAST(sum(n - 1) AS BIGINT) AS duplicate_rows"),
    )


@dataclass
class CleanReport:
    """The notebook's session cleaning, as lazy DataFrames."""

    cleaned: DataFrame
    nulls_before: DataFrame
    null_rows_before: DataFrame
    nulls_after: DataFrame
    duplicates: DataFrame


def clean_sessions(sessions: DataFrame, fills: dict[str, object] | None = None, sample_column: str = "utm_source") -> CleanReport:
    """Profile -> fill -> recheck -> duplicates. Duplicates are tested after the fill."""
    cleaned = fill_nulls(sessions, fills)
    return CleanReport(
        cleaned=cleaned,
        nulls_before=null_profile(sessions),
        null_rows_before=null_rows(sessions, sample_column),
        nulls_after=null_profile(cleaned),
        duplicates=duplicate_rows(cleaned),
    )
