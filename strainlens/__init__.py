"""Spark-native analytics for labelled sequence collections and their classifiers."""
