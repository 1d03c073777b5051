"""weftlake: a Spark-native engine for mining patterns over works, topics, countries and texts."""
