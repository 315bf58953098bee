"""Host telemetry on Spark: raw snapshots and frames to a bronze/silver/gold lakehouse."""
