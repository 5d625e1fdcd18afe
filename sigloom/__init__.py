"""Spark-native analytics for labelled multi-channel signals and event tables."""

__version__ = "0.1.0"
