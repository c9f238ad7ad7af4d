"""Spark-native analytics for positioned-text documents such as engineering plan sheets."""
