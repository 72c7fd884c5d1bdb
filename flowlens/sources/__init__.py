"""Readers, writers and the adapters that derive inputs from the driver tables."""
