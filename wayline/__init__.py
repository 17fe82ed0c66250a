"""Wayline: trajectory analytics as Spark DataFrame jobs."""
