"""Reusable relational building blocks the reports are composed of."""
