"""Sources and sinks. Importing the package registers the adapters and load strategies."""

from . import databases, files, managed
from .base import Adapter, LoadResult, WriteRequest, create_adapter

__all__ = ["Adapter", "LoadResult", "WriteRequest", "create_adapter", "databases", "files", "managed"]
