"""Social-sentiment and price analytics as composable Spark DataFrame transforms."""
