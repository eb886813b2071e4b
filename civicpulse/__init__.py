"""civicpulse: a PySpark-native analytics engine for municipal service requests."""

__version__ = "0.1.0"
