"""Composed plans: dataset build, evaluation protocol and the query catalog."""
