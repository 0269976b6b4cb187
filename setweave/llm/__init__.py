"""Corpus operators for training data: coding, deduplication, scoring, filtering and mixing."""
