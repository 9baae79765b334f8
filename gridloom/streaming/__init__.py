"""Rasters as streams."""
