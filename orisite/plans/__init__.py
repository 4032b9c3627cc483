"""End-to-end plans and the tables derived from the benchmark data."""
