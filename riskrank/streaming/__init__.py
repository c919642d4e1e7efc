"""Streaming scorer for incoming postings."""
