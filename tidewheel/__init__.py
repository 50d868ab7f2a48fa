"""Spark-native analytics over job-orchestration ledgers."""
