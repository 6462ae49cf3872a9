"""marlow: a PySpark-native engine for practice analytics."""
