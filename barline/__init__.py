"""A PySpark-native engine for panel research and training-data preparation."""
