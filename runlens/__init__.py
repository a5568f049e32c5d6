"""runlens: execution-telemetry analytics as PySpark DataFrame jobs over the logs of many applications at once."""
