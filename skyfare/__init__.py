"""Daily city-trip and weather analytics as plain Spark jobs."""
