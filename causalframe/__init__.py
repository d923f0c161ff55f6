"""A Spark-native engine for versioned key paths: change feeds, frontier, containers, composites, point queries."""
