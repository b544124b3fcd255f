"""Readers and writers."""

from .readers import read
from .sinks import write

__all__ = ["read", "write"]
