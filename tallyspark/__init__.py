"""Player-performance and betting-line analytics as composable Spark DataFrame transformations."""
