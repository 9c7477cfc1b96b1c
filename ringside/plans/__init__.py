"""Logical plans: relational queries written once and given to an engine."""
