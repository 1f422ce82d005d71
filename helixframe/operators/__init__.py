"""DataFrame operators on variant tables."""
