"""A Spark-native engine that builds, queries and learns over knowledge graphs."""
