"""A Spark-native engine for text retrieval and corpus analytics."""
