"""Spark-native analytics over engineering records: events, references, sessions, graphs and search."""

__version__ = "0.1.0"
