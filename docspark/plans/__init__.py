"""Queries over the driver's tables, and SQL that states the same."""
