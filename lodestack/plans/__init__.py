"""plans of the corpus jobs."""
