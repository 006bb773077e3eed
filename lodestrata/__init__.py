"""Lodestrata: a PySpark-native engine for code-agent trajectories and training data."""

__version__ = "0.1.0"
