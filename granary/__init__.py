"""Granary: a Spark-native relational analytics engine."""

__version__ = "0.1.0"
