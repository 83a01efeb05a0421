"""Data-parallel analytics kernels as Spark DataFrame operations."""
