"""Raster operators as narrow column expressions and relational aggregates."""
