"""Funnel step map: page url -> step number."""

from __future__ import annotations

from collections.abc import Mapping

from trailscope.functions.params import sql_str

# The site's purchase funnel, url -> step (1 = landing page).
DEFAULT_STEPS: dict[str, int] = {
    "/home": 1,
    "/lander-1": 1,
    "/products": 2,
    "/the-original-mr-fuzzy": 3,
    "/the-forever-love-bear": 3,
    "/the-birthday-sugar-panda": 3,
    "/cart": 4,
    "/shipping": 5,
    "/billing": 6,
    "/thank-you-for-your-order": 7,
}

# Funnel report columns per step, in step order: (sessions reaching
# the step, share of them leaving before the next step).
DEFAULT_FUNNEL_COLUMNS = [
    ("total_sessions", "lp_exit_rate"),
    ("product_sessions", "prod_exit_rate"),
    ("proddetail_sessions", "proddetail_exit_rate"),
    ("cart_sessions", "cart_exit_rate"),
    ("shipping_sessions", "shipping_exit_rate"),
    ("billing_sessions", "billing_exit_rate"),
    ("thanks_sessions", None),
]


def step_sql(col: str, steps: Mapping[str, int] = DEFAULT_STEPS) -> str:
    """Step number of a url as a SQL ``CASE`` (NULL for pages outside the funnel).

    The same text runs in Spark and in DuckDB (oracles). The map is a handful
    of literals inside the expression: nothing is joined or broadcast, and it
    stays inside whole-stage codegen.
    """
    by_step: dict[int, list[str]] = {}
    for page, step in steps.items():
        by_step.setdefault(int(step), []).append(page)
    arms = " ".join(
        f"WHEN {col} IN ({', '.join(sql_str(p) for p in pages)}) THEN {step}" for step, pages in sorted(by_step.items())
    )
    return f"CASE {arms} ELSE NULL END" if arms else "CAST(NULL AS INT)"


def max_step(steps: Mapping[str, int] = DEFAULT_STEPS) -> int:
    return max(int(s) for s in steps.values())
