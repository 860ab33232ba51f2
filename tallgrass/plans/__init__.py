"""Predicates and their lowering to columns, and plans as JSON."""
