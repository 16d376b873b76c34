"""Column functions: all built from Spark SQL built-ins."""
