"""Zone-free time parts for ``TIMESTAMP_NTZ`` columns.

``date_trunc`` and ``date_format`` route NTZ values through the session time
zone, so these helpers use only ``CAST(... AS DATE)``, ``weekday``,
``dayofweek``, ``hour`` and NTZ subtraction, which never consult a zone.
Each helper gives expression text, for composing.
"""

from __future__ import annotations

# Lower-case English day names indexed by dayofweek() (1 = Sunday).
DAY_NAMES = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def week_start_sql(ts: str) -> str:
    """Monday of the week containing ``ts`` as a DATE (``DATE_TRUNC('week')::date``)."""
    return f"date_sub(CAST({ts} AS DATE), weekday(CAST({ts} AS DATE)))"


def day_name_sql(ts: str) -> str:
    """Lower-case weekday name without padding (``TRIM(TO_CHAR(ts, 'day'))``)."""
    names = ", ".join(f"'{n}'" for n in DAY_NAMES)
    return f"element_at(array({names}), dayofweek(CAST({ts} AS DATE)))"


def hour_1_24_sql(ts: str) -> str:
    """Hour of day with midnight reported as 24 instead of 0."""
    return f"CASE WHEN hour({ts}) = 0 THEN 24 ELSE hour({ts}) END"


def micros_between_sql(lo: str, hi: str) -> str:
    """Exact microseconds from ``lo`` to ``hi`` (both NTZ) as BIGINT."""
    return f"CAST(CAST(CAST({hi} - {lo} AS INTERVAL SECOND) AS DECIMAL(20,6)) * 1000000 AS BIGINT)"
