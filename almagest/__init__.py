"""almagest: a Spark-native analytics engine for corpora of scientific documents."""

__version__ = "0.1.0"
