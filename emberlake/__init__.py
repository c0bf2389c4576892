"""Gridded fire-risk analytics as DataFrame operators on Apache Spark."""
