"""Web-estate audit analytics as Spark jobs."""
