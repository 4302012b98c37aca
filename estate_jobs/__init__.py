"""Property-screening jobs on Spark."""
