"""Steps on graphs."""
