"""Street-level observation analytics as PySpark table-in, table-out operators."""
