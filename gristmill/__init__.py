"""gristmill: a PySpark-native engine for listing-market analytics."""

__version__ = "0.1.0"
