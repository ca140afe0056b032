"""Spark-native analytics over group-structured tables of vectors and labels."""
