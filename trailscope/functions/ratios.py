"""Ratios of aggregates with NULL on a zero denominator, and money casts (SQL text)."""

from __future__ import annotations


def safe_ratio_sql(num: str, den: str, scale: int | None = None) -> str:
    """``num / den`` as DOUBLE; NULL when ``den`` is 0 or NULL.

    The reference divides with ``::float`` (8-byte), which would raise on zero;
    here a zero denominator yields NULL instead of failing the whole report.
    """
    r = f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"
    return f"round({r}, {scale})" if scale is not None else r


def money_sql(expr: str, scale: int = 2) -> str:
    return f"CAST({expr} AS DECIMAL(18,{scale}))"


def round_ratio_half_up_sql(num: str, den: str, places: int = 2) -> str:
    """``ROUND(num / den, places)`` of two non-negative integers, exactly (half up), as DOUBLE.

    Integer arithmetic instead of a rounded double quotient, so every engine
    gets the same digits. NULL when ``den`` is 0 or NULL.
    """
    n = f"CAST({num} AS DECIMAL(38,0))"
    d = f"CAST({den} AS DECIMAL(38,0))"
    scale = 10**places
    # ``div`` is exact integral division (a decimal ``/`` would round the quotient first).
    return f"CASE WHEN {d} > 0 THEN CAST(({n} * {2 * scale} + {d}) div ({d} * 2) AS DOUBLE) / {float(scale)} END"
