"""Checked queries: inputs derived from the given tables, jobs on them, and the same answers in SQL."""
