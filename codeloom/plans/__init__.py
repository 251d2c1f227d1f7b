"""Whole queries: the user-facing ones, and those over the driver's tables."""
