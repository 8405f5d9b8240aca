"""lectern - a Spark-native engine for archives of documents and passages."""

__version__ = "0.1.0"
