"""Spark jobs for media-library catalogues held as tables."""
