"""Entity-performance analytics as Spark plans: rollups, rates, windows, retrieval, spatial grids and matching."""
