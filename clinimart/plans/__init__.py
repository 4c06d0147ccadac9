"""Warehouse load, reports and summaries."""
