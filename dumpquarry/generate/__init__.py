"""generate."""
