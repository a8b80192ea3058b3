"""Spatial-hierarchy analytics on Spark: points as rows, Morton codes as keys, octrees as tables."""
