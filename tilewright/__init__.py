"""Spark-first analytics for multiplexed tissue imaging tables."""
