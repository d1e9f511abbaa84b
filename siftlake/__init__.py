"""Spark-native analytics over code-review security findings, and operators for training-data pipelines."""
