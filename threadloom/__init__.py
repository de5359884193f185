"""Spark-native analytics over archives of code-review and issue discussions."""
