"""Reusable DataFrame operators: lookups, grouped text, ranking, density, quantiles."""
