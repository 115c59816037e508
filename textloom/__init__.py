"""textloom: a Spark-native engine for document retrieval and text analytics."""

__version__ = "0.1.0"
