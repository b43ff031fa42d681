"""Graphs and parameters from tables and files, and results to files."""
