"""Spark-native dataset trust analytics: integrity queries over training and evaluation artifacts."""

__version__ = "0.1.0"
