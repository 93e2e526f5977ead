"""streaming of the corpus jobs."""
