"""gridloom: a Spark-native engine for gridding irregular observations."""
