"""A PySpark-native engine for scholarly-evidence pipelines."""
