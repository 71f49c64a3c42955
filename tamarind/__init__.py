"""tamarind: a PySpark-native engine for merchant-signal analytics."""

__version__ = "0.1.0"
