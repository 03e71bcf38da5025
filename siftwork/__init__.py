"""siftwork: a PySpark-native engine for text structuring, grain changes and topic analytics."""

__version__ = "0.1.0"
