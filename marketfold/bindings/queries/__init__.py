"""Importing this package registers every query."""

from . import commerce, ingest, insights, landing, listings, quality, relational, scalars  # noqa: F401
