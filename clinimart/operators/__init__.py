"""Reusable DataFrame operators: ordering, stays, quality, admission, tables."""
