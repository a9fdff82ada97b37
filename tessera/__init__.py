"""Spark-native document analytics: every operator is a function from DataFrame to DataFrame."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
