"""Image files, generated rasters and rasters from tables."""
