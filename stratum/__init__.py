"""Stratum: a Spark-native engine for spatial and spatio-temporal data."""

__version__ = "0.1.0"
