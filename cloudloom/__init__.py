"""Spark-native analytics over large collections of labelled 3-D point clouds."""
