"""Registered queries, by part of the inventory."""

from . import documents, files, listing, relations, search, shapes, streams, structure  # noqa: F401
