"""Spark-native analytics for sensor time series, with an optional corpus-preparation subpackage."""
