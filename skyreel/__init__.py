"""Spark-native analytics for live video streams, sensor telemetry and a document catalog."""
