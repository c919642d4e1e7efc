"""Readers and writers (raw postings, splits, scores, experiment log, caches)."""
