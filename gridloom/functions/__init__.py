"""Column functions over planes: arrays of w * h samples, row by row."""
