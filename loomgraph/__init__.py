"""A PySpark-native engine for code graphs and repository text."""
