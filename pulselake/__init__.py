"""Per-customer request telemetry analytics on PySpark."""
