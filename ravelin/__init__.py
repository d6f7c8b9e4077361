"""A PySpark-native engine for resource-oriented queries."""
