"""Report parameters: date window, traffic segment, tables bundle.

Predicates are built as Spark SQL expression text and wrapped once in
``F.expr``: one call into the JVM per predicate instead of one per column
reference and operator, and the same plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(value: str | dt.datetime) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    return dt.datetime.fromisoformat(value)


# Month of ``created_at`` (first day, a DATE): the partition column of stored page views.
# The name is reserved: only the storage layout writes it, so no column of a user's input is taken for it.
PARTITION_COLUMN = "trailscope_created_month__"
PARTITION_SQL = "trunc(CAST(created_at AS DATE), 'MM')"


# Number of equal rows that a stored or folded row stands for. Reserved like the name above; tables without it have one row per row.
COPIES = "trailscope_copies__"


def copies_sql(df: DataFrame) -> str:
    """SQL text of the number of rows each row of ``df`` stands for."""
    return COPIES if COPIES in df.columns else "1L"


def count_sql(df: DataFrame, column: str | None = None) -> str:
    """SQL text of ``count(column)`` (``count(*)`` without one) over the rows that ``df`` stands for."""
    if COPIES not in df.columns:
        return f"count({column or 1})"
    each = f"CASE WHEN {column} IS NOT NULL THEN {COPIES} END" if column else COPIES
    return f"coalesce(sum({each}), 0L)"


def times_copies_sql(df: DataFrame, value: str, decimal: bool = False) -> str:
    """SQL text of ``value`` times the number of rows each row of ``df`` stands for."""
    if COPIES not in df.columns:
        return value
    return f"{value} * CAST({COPIES} AS DECIMAL(10,0))" if decimal else f"{value} * {COPIES}"


def sql_str(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class ReportWindow:
    """Inclusive timestamp window ``lo <= created_at <= hi``.

    Bounds are zone-free (``TIMESTAMP_NTZ`` literals), so the result does not
    depend on the session time zone. ``half_open=True`` turns the upper bound
    into ``created_at < hi``.
    """

    lo: dt.datetime
    hi: dt.datetime
    half_open: bool = False

    @classmethod
    def of(cls, lo: str | dt.datetime, hi: str | dt.datetime, half_open: bool = False) -> "ReportWindow":
        return cls(_ts(lo), _ts(hi), half_open)

    def _bounds(self, literal: str) -> tuple[str, str]:
        return (f"{literal} '{self.lo.isoformat(sep=' ')}'", f"{literal} '{self.hi.isoformat(sep=' ')}'")

    def condition(self, col: str = "created_at") -> str:
        """Spark SQL text of the predicate on ``col``."""
        lo, hi = self._bounds("TIMESTAMP_NTZ")
        if self.half_open:
            return f"({col} >= {lo} AND {col} < {hi})"
        return f"({col} BETWEEN {lo} AND {hi})"

    def contains(self, col: str = "created_at") -> Column:
        return F.expr(self.condition(col))

    def restrict(self, df: DataFrame, col: str = "created_at") -> DataFrame:
        """Rows of ``df`` inside the window. When ``df`` is stored partitioned by
        month (:data:`PARTITION_COLUMN`), the matching month predicate is added so
        Spark prunes whole partition directories before any file is opened."""
        cond = self.condition(col)
        if col == "created_at" and PARTITION_COLUMN in df.columns:
            first, last = self.lo.date().replace(day=1), self.hi.date().replace(day=1)
            cond = f"{cond} AND {PARTITION_COLUMN} BETWEEN DATE '{first}' AND DATE '{last}'"
        return df.filter(cond)

    def sql(self, col: str) -> str:
        """The same predicate as DuckDB / ANSI SQL text (used by oracles)."""
        lo, hi = self._bounds("TIMESTAMP")
        if self.half_open:
            return f"({col} >= {lo} AND {col} < {hi})"
        return f"({col} BETWEEN {lo} AND {hi})"


@dataclass(frozen=True)
class Segment:
    """A traffic segment: utm source and campaign pair (``None`` = any)."""

    source: str | None = None
    campaign: str | None = None

    def condition(self, prefix: str = "") -> str:
        parts = []
        if self.source is not None:
            parts.append(f"{prefix}utm_source = {sql_str(self.source)}")
        if self.campaign is not None:
            parts.append(f"{prefix}utm_campaign = {sql_str(self.campaign)}")
        return " AND ".join(parts) if parts else "TRUE"

    def predicate(self, prefix: str = "") -> Column:
        return F.expr(self.condition(prefix))

    @property
    def is_all(self) -> bool:
        return self.source is None and self.campaign is None


ALL_TRAFFIC = Segment()


class WebTables(NamedTuple):
    """The three input relations of the analyses.

    ``sessions`` may be a counted table, whose rows stand for :data:`COPIES` equal ones (as stored by
    ``store_tables``); every report weights them. ``order_facts`` optionally holds the orders already folded per session
    (``website_session_id, n_orders, sales, cost``), e.g. a stored table
    bucketed like the sessions; reports then skip re-aggregating orders.
    """

    sessions: DataFrame
    pageviews: DataFrame
    orders: DataFrame
    order_facts: DataFrame | None = None


TABLE_NAMES = ("sessions", "pageviews", "orders")
