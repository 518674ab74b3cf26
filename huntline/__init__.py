"""Spark-native analytics and detection over host telemetry events."""
