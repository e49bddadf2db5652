"""driftwell: range sampling over changing data, written for Spark's DataFrame engine."""
