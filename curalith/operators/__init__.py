"""Operators on manifests, predictions and histories: DataFrame -> DataFrame."""
