"""Structured page documents, their geometry and edit history as Spark DataFrames."""

__version__ = "0.1.0"
