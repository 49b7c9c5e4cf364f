"""Variorum: fuse several noisy transcriptions of the same pages into one text, as Spark jobs."""

__version__ = "0.1.0"
