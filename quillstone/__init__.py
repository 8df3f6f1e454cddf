"""Spark-first analytics over scored profile snapshots."""
