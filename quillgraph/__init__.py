"""A Spark-native engine for research knowledge graphs and document collections."""
