"""Spatial-textual analytics on Spark."""
