"""marigold: Spark-native profile, similarity and rating analytics."""
