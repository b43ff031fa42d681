"""Whole queries, their registry, and running many of them."""
