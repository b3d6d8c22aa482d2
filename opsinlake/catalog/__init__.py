"""Registered queries, each with the SQL that must give the same rows."""

from opsinlake.catalog import images, levels, lights, points, spectra, systems  # noqa: F401  (fill the registry)
from opsinlake.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
