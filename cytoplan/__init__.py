"""Spark-native analytics for cell x gene count tables and trajectories."""

VERSION = "0.3.0"
