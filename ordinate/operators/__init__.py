"""Operators on tensor relations and keyed sequences."""
