"""Column functions: text, numbers, dates, geometry, fonts, provenance."""
