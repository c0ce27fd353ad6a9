"""Spark-native text comparison: tokens, edit operations, changes, statistics and renderings of text pairs."""
