"""Foliomill: a Spark-native engine for building and auditing document corpora."""
