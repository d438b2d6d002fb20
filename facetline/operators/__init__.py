"""Relational and graph operators over the fact tables."""
