"""Base tables and index tables."""
