"""Interval, signal and sequence-graph analytics on PySpark DataFrames."""

__version__ = "0.1.0"
