"""Funnel reports: sessions per step with exit rates, and the chain table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import ALL_TRAFFIC, ReportWindow, Segment, WebTables
from trailscope.functions.ratios import safe_ratio_sql
from trailscope.functions.steps import DEFAULT_FUNNEL_COLUMNS, DEFAULT_STEPS, max_step
from trailscope.operators.chains import funnel_chains, funnel_depth
from trailscope.operators.ranking import DEFAULT_CHUNK_ROWS, leading_pages, over_ranks
from trailscope.operators.rollup import SID, segment_sessions

E = F.expr


def _columns(n_steps: int, columns: Sequence[tuple[str, str | None]] | None) -> list[tuple[str, str | None]]:
    if columns is not None:
        return list(columns)
    if n_steps == len(DEFAULT_FUNNEL_COLUMNS):
        return list(DEFAULT_FUNNEL_COLUMNS)
    return [(f"step{k}_sessions", f"step{k}_exit_rate" if k < n_steps else None) for k in range(1, n_steps + 1)]


def funnel_report(
    tables: WebTables,
    window: ReportWindow,
    steps: Mapping[str, int] = DEFAULT_STEPS,
    segment: Segment = ALL_TRAFFIC,
    columns: Sequence[tuple[str, str | None]] | None = None,
) -> DataFrame:
    """One row: sessions reaching each step on a strict path from page 1, and the
    exit rate of each step (``1 - next / this``).

    Only the first ``max_step`` pages of a session can be on its valid chain, so
    the ranking is limited to them (a partial ``WindowGroupLimit`` before the
    shuffle, where equal page views are folded); each session yields its chain depth and one aggregate counts
    ``depth >= k``: no recursion, no distinct counts.
    """
    k_max = max_step(steps)
    pv = window.restrict(tables.pageviews)
    depth = funnel_depth(leading_pages(pv, k_max), steps, page="page")
    if not segment.is_all:
        depth = depth.join(segment_sessions(tables.sessions, segment), SID, "left_semi")
    cols = _columns(k_max, columns)
    counts = depth.agg(*[E(f"CAST(count_if(depth >= {k}) AS BIGINT) AS __s{k}") for k in range(1, k_max + 1)])
    out = []
    for k, (sess_name, exit_name) in enumerate(cols, start=1):
        out.append(E(f"__s{k} AS {sess_name}"))
        if exit_name is not None and k < k_max:
            out.append(E(f"1.0D - {safe_ratio_sql(f'__s{k + 1}', f'__s{k}')} AS {exit_name}"))
    return counts.select(*out)


def funnel_table(
    tables: WebTables,
    window: ReportWindow,
    steps: Mapping[str, int] = DEFAULT_STEPS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Every funnel chain that starts at a step-1 page, valid or not:
    ``website_session_id, pageview_url, funnel_step, user_page_step, is_valid_step``
    (``is_valid_step`` = 1 for the chain from page 1, else NULL)."""
    pv = window.restrict(tables.pageviews).select(SID, "website_pageview_id", "pageview_url")
    return over_ranks(pv, lambda ranked: funnel_chains(ranked, steps), chunk_rows)
