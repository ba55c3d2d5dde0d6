"""Composed jobs: the offline training pipeline, batch recommendations and
the registry of named queries over the driver tables."""
