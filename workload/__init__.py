"""Telemetry tables and frames projected from the test tables, the registered queries and their SQL."""
