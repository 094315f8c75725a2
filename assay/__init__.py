"""Data-test signal analytics and corpus processing on Spark."""
