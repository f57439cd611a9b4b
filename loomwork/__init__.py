"""Loomwork: PySpark-native analytics for industry time series, firm metrics and text corpora."""

__version__ = "0.1.0"
