"""Scans of tables and of files, and sinks."""
