"""Spark jobs over entity-by-week panels."""
