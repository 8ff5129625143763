"""Spark-native analytics over property graphs, matrices, series, tours and grids."""

__version__ = "0.1.0"
