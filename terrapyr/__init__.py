"""Terrain-pyramid analytics and data-pipeline operators on PySpark."""

__version__ = "0.1.0"
