"""Composite jobs, and the queries run on the driver's tables."""
