"""Reusable relational operators: data quality, session rollup, ranking, funnel chains, row expansion."""
