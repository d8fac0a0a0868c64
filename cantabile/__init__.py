"""Spark-native analytics for timed text: tracks made of ordered, timed lines and words."""
