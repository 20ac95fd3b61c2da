"""Spark-native analytics over named, typed, ordered sheets."""
