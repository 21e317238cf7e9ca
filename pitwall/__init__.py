"""Inspection-point analytics on Spark: validation, features, forecasts, decisions, overrides, reports."""
