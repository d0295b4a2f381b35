"""Coverage clustering and comparison of news articles as Spark jobs."""
