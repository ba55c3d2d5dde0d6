"""Schemas, readers, writers and the fixture tables derived from the driver data."""
