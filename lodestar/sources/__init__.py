"""Readers of landed files and adapters to the canonical tables."""
