"""quern: a PySpark-native engine for semantic query processing and large-scale data preparation."""

__version__ = "0.1.0"
