"""Behavioural code analysis on Spark: hotspots, change coupling, ownership, trends and findings."""
