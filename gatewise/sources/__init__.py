"""Readers, writers and the fixture tables derived from the driver tables."""
