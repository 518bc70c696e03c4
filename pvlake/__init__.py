"""Spark-native analytics for fleets of photovoltaic sites."""
