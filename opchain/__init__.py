"""A PySpark-native engine for large sums of products of local operators."""
