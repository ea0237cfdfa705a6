"""Geometry in numpy and plain Python; nothing here knows Spark."""
