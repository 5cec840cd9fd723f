"""siftworks: a PySpark-native engine for building, auditing and evaluating training data."""

__version__ = "0.1.0"
