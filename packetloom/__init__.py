"""Spark-native network-telemetry forecasting."""
