"""loomspan: a Spark-native engine for context retrieval and session memory analytics."""
