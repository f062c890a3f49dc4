"""The reports, grouped by subject."""
