"""Spark-native text-signal and panel analytics engine."""

__version__ = "0.1.0"
