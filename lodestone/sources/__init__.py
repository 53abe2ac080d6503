"""Stored indexes, versioned tables and generated input."""
