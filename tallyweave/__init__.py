"""A Spark-native engine for comparing label and document records."""
