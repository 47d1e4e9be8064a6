"""Document knowledge engine on PySpark."""
