"""Inner join of page views on the session and a time range in the ``ON`` clause.

``left JOIN page views ON left.session = views.session AND views.created_at BETWEEN lo AND hi``, where ``lo`` and
``hi`` are a report window or expressions over each left row. The range prunes the right side before it is joined,
and a session that holds a large share of the page views is joined in several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import PARTITION_COLUMN, ReportWindow
from trailscope.operators.ranking import DEFAULT_CHUNK_ROWS, SID, hot_sessions

E = F.expr


def prune_by_bounds(views: DataFrame, left: DataFrame, lo: str, hi: str) -> DataFrame:
    """Page views between the smallest ``lo`` and the largest ``hi`` of ``left``.

    Both bounds are measured by scalar subqueries that run before the scan: they prune the month directories of
    stored page views and skip row groups inside them.
    """
    first, last = left.agg(E(f"min({lo})")).scalar(), left.agg(E(f"max({hi})")).scalar()
    within = (F.col("created_at") >= first) & (F.col("created_at") <= last)
    if PARTITION_COLUMN in views.columns:
        month = [F.trunc(bound.cast("date"), "MM") for bound in (first, last)]
        within = within & (F.col(PARTITION_COLUMN) >= month[0]) & (F.col(PARTITION_COLUMN) <= month[1])
    return views.filter(within)


def join_in_range(
    left: DataFrame,
    pageviews: DataFrame,
    on: ReportWindow | tuple[str, str],
    columns: tuple[str, ...] = ("website_pageview_id", "created_at", "pageview_url"),
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Rows of ``left`` with each page view of their session in range; the page view's ``columns`` are appended.

    ``on`` is a window, or the SQL text of both (inclusive) bounds over ``left``. Columns of ``left`` that are
    named like one of ``columns`` must be renamed before. Rows without a session, time or bound match nothing, as in SQL.

    The page views of a hot session are dealt over ``parts`` by their place in the input, and its left rows are repeated once per part, so equal page views are
    split as well. The list of hot sessions is bounded (``ranking.MAX_HOT_SESSIONS``) and therefore broadcast.
    """
    taken = [c for c in columns if c in left.columns]
    if taken:
        raise ValueError(f"rename columns of the left side first: {taken}")
    if isinstance(on, ReportWindow):
        views = on.restrict(pageviews)
        bounded, test = left, "TRUE"
    else:
        lo, hi = on
        views = prune_by_bounds(pageviews, left, lo, hi)
        bounded, test = left.select("*", E(f"{lo} AS __lo"), E(f"{hi} AS __hi")), "created_at BETWEEN __lo AND __hi"
    views = views.select(SID, *dict.fromkeys([*columns, "created_at"]))
    hot = F.broadcast(hot_sessions(views, chunk_rows).select("__hot", E(f"CAST(ceil(__n / {float(chunk_rows)}) AS INT) AS __parts")))
    spread = views.withColumn("__at", F.monotonically_increasing_id()).join(hot, E(f"{SID} = __hot"), "left")
    right = spread.select(E(f"named_struct('s', {SID}, 'part', coalesce(CAST(pmod(__at, __parts) AS INT), 0)) AS __on"), *[c for c in views.columns if c != SID])
    parts = bounded.join(hot, E(f"{SID} = __hot"), "left").withColumn("__part", E("explode(sequence(0, coalesce(__parts, 1) - 1))"))
    keyed = parts.withColumn("__on", E(f"named_struct('s', {SID}, 'part', __part)")).filter(f"{SID} IS NOT NULL")
    return keyed.join(right, "__on").filter(test).select(*left.columns, *columns)
