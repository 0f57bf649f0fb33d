"""allelic: a Spark-native engine for variant annotation and tabular analytics."""

__version__ = "0.1.0"
