"""Column functions built from Spark expressions."""
