"""Spark jobs for indexing source-code corpora and preparing training text."""
