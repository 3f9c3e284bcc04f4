"""Operators on tables of assets."""
