"""Registered queries with their SQL counterparts, one module per operator family."""

from curascore.catalog import curation, files, labels, metrics, text, vectors  # noqa: F401  (they register on import)
from curascore.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
