"""Compositions of jobs."""
