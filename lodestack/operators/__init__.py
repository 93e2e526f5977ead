"""operators of the corpus jobs."""
