"""The flagship plan: hybrid keyword and vector search."""

from __future__ import annotations

from siltstone.operators.search import q_hybrid_search as flagship

__all__ = ["flagship"]
