"""Column expressions: 360-day calendar, binning, storm shape, geometry, statistics."""
