"""lodestack: a Spark-native engine for provenance-tracked document corpora."""

__version__ = "0.1.0"
