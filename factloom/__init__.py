"""Spark-native analytics over code facts, findings, verdicts and code graphs."""
