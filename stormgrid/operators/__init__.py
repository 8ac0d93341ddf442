"""DataFrame to DataFrame operators: joins, aggregates, windows, grids, rasters, reports."""
