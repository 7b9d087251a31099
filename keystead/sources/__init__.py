"""Scans, sinks, page extraction jobs and feed readers."""
