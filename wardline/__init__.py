"""wardline: a PySpark-native text-safety analytics engine."""

__version__ = "0.1.0"
