"""Marketplace and rental-listing analytics as Spark DataFrame operators."""

from .session import prepare

__all__ = ["prepare"]
