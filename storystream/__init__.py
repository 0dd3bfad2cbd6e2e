"""Spark jobs over news articles: ingest, duplicates, topics, stories, listings."""
