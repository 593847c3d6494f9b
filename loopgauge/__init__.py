"""Spark-native analysis of source code corpora, and the table operators it is built from."""
