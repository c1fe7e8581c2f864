"""Spark-native analytics for serialized long-form text and the work that turns it into audio."""
