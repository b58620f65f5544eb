"""A PySpark-native engine for retrieval and grounded question answering."""
