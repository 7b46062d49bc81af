"""Batch analytics of periodic biological time series on Spark."""
