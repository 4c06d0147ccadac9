"""Column expressions shared by every plan: ratios, bands, dates, text."""
