"""Column expressions: names and times, cell values, grids, projections."""
