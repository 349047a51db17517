"""Composite analyses: one function per report, each a lazy DataFrame plan."""
