"""Rental-listing analytics as Spark DataFrame, SQL and streaming jobs."""
