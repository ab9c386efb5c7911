"""Vexel: a Spark-first engine for feature analytics."""
