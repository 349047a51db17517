"""Funnel chains without recursion.

The reference grows chains with a recursive join: a chain starts at any
step-1 page and extends to the next page only when both the page position and
the funnel step rise by one. Along a chain ``position - step`` is therefore
constant, so every chain lies on one diagonal ``d = position - step`` of its
session and starts at position ``d + 1``. On a diagonal the chain is the run of
rows whose steps are 1, 2, 3, ... with no gap: ``dense_rank() over (session, d
order by step) = step``. Page views with equal ids share a position and a step, and the position after
them is skipped, so such a tie ends its chain, and all its rows belong to it. A chain is valid (walked from the first page) iff
``d = 0``.

Each (session, diagonal) partition holds at most one row per step and tie, so
the window stays small however long a session is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.functions.params import COPIES
from trailscope.functions.steps import DEFAULT_STEPS, step_sql

SID = "website_session_id"
E = F.expr


def funnel_chains(ranked: DataFrame, steps: Mapping[str, int] = DEFAULT_STEPS, rank_col: str = "rank_page") -> DataFrame:
    """All chain rows: ``website_session_id, pageview_url, funnel_step, user_page_step, is_valid_step``.

    ``ranked`` holds page views with their in-session rank (``rank_col``). Rows that stand for
    several equal views (``COPIES``) keep their number.
    """
    carried = [COPIES] if COPIES in ranked.columns else []
    rows = ranked.select(
        SID,
        "pageview_url",
        *carried,
        E(f"{step_sql('pageview_url', steps)} AS funnel_step"),
        E(f"CAST({rank_col} AS INT) AS user_page_step"),
    ).filter("funnel_step IS NOT NULL")
    # One composite window key: a partitioning on the session alone cannot satisfy it.
    return (
        rows.withColumn("__d", E("user_page_step - funnel_step"))
        .withColumn("__n", E(f"dense_rank() OVER (PARTITION BY named_struct('s', {SID}, 'd', __d) ORDER BY funnel_step)"))
        .filter("__n = funnel_step")
        .select(
            SID,
            "pageview_url",
            E("CAST(funnel_step AS INT) AS funnel_step"),
            "user_page_step",
            E("CAST(CASE WHEN __d = 0 THEN 1 END AS INT) AS is_valid_step"),
            *carried,
        )
    )


def funnel_depth(
    first: DataFrame, steps: Mapping[str, int] = DEFAULT_STEPS, rank_col: str = "rank_page", page: str = "pageview_url"
) -> DataFrame:
    """Per session the last step of its valid chain (0 if page 1 is not a step-1 page).

    ``first`` holds the first ``max_step`` ranked page views of each session;
    the valid chain covers positions 1..depth with steps 1..depth.
    """
    st = step_sql(page, steps)
    # One bit per position whose step fits; the depth is the run of ones from the first bit. A tie skips a bit.
    mask = f"bit_or(CASE WHEN ({st}) = {rank_col} THEN shiftleft(1L, CAST({rank_col} AS INT) - 1) ELSE 0L END)"
    run = "aggregate(sequence(0, 62), 0, (n, k) -> IF(n = k AND (shiftright(__mask, k) & 1L) = 1L, n + 1, n))"
    return first.groupBy(SID).agg(E(f"{mask} AS __mask")).select(SID, E(f"CAST({run} AS INT) AS depth"))


def successor_pairs(ranked: DataFrame, steps: Mapping[str, int] = DEFAULT_STEPS, rank_col: str = "rank_page") -> DataFrame:
    """Pairs of consecutive pages whose funnel step also rises by one (the recursion's join step):
    ``website_session_id, from_url, to_url, from_step, from_rank``.

    Position and step both rise by one, so a pair is two neighbours on one
    (session, position - step) diagonal, and the earlier one is alone on its step (after a tie the
    next position is skipped): each row looks back by one step on its diagonal, without joining the page views to themselves.
    A row that stands for several equal views (``COPIES``) is several later pages; it can't be an earlier one.
    """
    carried = [COPIES] if COPIES in ranked.columns else []
    stepped = ranked.select(
        SID, "pageview_url", *carried, E(f"CAST({rank_col} AS INT) AS __rank"), E(f"CAST({step_sql('pageview_url', steps)} AS INT) AS __step")
    ).filter("__step IS NOT NULL")
    back = f"OVER (PARTITION BY named_struct('s', {SID}, 'd', __rank - __step) ORDER BY __step RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    return (
        stepped.select("*", E(f"first_value(pageview_url) {back} AS from_url"), E(f"count(1) {back} AS __before"))
        .filter("__before > 0")
        .select(
            SID,
            "from_url",
            E("pageview_url AS to_url"),
            E("__step - 1 AS from_step"),
            E("__rank - 1 AS from_rank"),
            *carried,
        )
    )
