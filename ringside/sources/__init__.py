"""Readers, parsers and adapters."""
