"""Schemas, their validation, and the catalogue of names."""
