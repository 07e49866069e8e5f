"""Every operator as a named query over the given tables."""

from . import climate, comparisons, models, relational, sources, vegetation  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
