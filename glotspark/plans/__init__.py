"""Registered queries: ``registry`` holds the tables, the others add to them."""

from . import extra, knowledge, more, quality, registry

__all__ = ["extra", "knowledge", "more", "quality", "registry"]
