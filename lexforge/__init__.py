"""lexforge: a PySpark-native engine for corpus vocabulary analytics."""

__version__ = "0.1.0"
