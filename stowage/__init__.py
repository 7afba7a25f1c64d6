"""stowage: per-value packed columns for PySpark."""
