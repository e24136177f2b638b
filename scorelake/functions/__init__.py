"""Column-level building blocks; every function returns native Spark expressions."""
