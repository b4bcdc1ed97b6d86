"""Readers, writers and the views built on the driver tables."""
