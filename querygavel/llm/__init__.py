"""Operators for training-data pipelines, each by its stated method."""
