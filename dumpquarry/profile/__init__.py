"""profile."""
