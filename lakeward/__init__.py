"""Lakeward: Spark-native governed lakehouse analytics."""
