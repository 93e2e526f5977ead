"""sources of the corpus jobs."""
