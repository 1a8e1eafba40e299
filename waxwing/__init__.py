"""waxwing: ordered-catalogue analytics as composable Spark DataFrame operators."""
