"""Lodestone: entity vectors, ranking, retrieval metrics and clustered inference as Spark jobs."""
