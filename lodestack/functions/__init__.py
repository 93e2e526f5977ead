"""functions of the corpus jobs."""
