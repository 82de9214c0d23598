"""Spark-native engine for keyed event and telemetry analytics."""
