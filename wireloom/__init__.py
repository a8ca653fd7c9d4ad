"""A Spark-native engine for syndication-feed data."""
