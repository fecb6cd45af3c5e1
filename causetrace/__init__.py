"""Spark-native root-cause diagnosis of telemetry, at fleet scale."""
