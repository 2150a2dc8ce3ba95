"""Isobar: Spark-native analytics for gridded climate fields and event tables."""
