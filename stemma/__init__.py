"""Stemma: a Spark-native temporal entity-graph analytics engine."""
