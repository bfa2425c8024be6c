"""Spark-native analytics over ensembles of frames, contacts and records."""
