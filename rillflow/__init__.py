"""A PySpark-native engine for event analytics over bounded and unbounded data."""
