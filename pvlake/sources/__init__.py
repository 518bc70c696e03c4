"""Readers, writers and the adapter from the driver's tables."""
