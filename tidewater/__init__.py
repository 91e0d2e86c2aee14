"""Tidewater: a Spark-native analytics engine for a retail data platform."""
