"""Scalar column helpers: time parts, funnel steps, ratios, report parameters."""
