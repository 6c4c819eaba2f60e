"""Corridor: Spark jobs for road-trip analytics.

Every operator is a function from DataFrames (or Columns) to a DataFrame (or a
Column), built from Spark's own expressions, joins and aggregates.
"""
