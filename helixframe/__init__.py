"""Spark-native variant-effect analytics: features, models and corpus operators as DataFrame plans."""
