"""logloom: a Spark-native log normalisation and analytics engine."""

__version__ = "0.1.0"
