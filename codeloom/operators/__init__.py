"""Relational and graph operators over the index tables."""
