"""Spark-native preparation, validation, packing, addressing and measurement of training corpora."""
