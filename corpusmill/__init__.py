"""Corpusmill: a Spark-native analytics engine over document corpora."""
