"""The actions of transform steps. Importing the package registers them."""

from . import cdc, collection, element, fuzzy, sets
from .base import Transform, build_transform

__all__ = ["Transform", "build_transform", "cdc", "collection", "element", "fuzzy", "sets"]
