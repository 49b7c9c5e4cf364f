"""Readers and writers over Spark data sources."""
