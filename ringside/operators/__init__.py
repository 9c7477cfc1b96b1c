"""Operators over canonical tables."""
