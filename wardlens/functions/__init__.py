"""Column -> Column helpers built from Spark SQL built-ins."""
