"""Operators of a training-data pipeline: filters, duplicates, text extraction, formats and tokens."""
