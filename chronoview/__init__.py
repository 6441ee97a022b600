"""Temporal multi-view cohort and reliability analytics as Spark jobs."""
