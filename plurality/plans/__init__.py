"""Plan-shape helpers: skew-safe joins, distributed ranks, lineage cuts."""
