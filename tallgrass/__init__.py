"""Typed tables and their query engine on Spark."""
