"""Connected components, from the core."""

from sparkcohort.operators.components import connected_components

__all__ = ["connected_components"]
