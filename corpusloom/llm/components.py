"""Connected components of links, as the engine has them."""

from __future__ import annotations

from corpusloom.operators.graph import connected_components

__all__ = ["connected_components"]
