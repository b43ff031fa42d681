"""Predicates and column functions."""
