"""Density clustering of two-dimensional points under many parameter settings, on Spark."""
