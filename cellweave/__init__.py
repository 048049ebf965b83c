"""cellweave: a PySpark-native engine for annotated cell-by-feature matrices."""

__version__ = "0.1.0"
