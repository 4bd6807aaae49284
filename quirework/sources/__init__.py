"""Schemas, readers and adapters that yield document tables."""
