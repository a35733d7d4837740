"""A PySpark-native engine for scholarly-document collections."""

__version__ = "0.1.0"
