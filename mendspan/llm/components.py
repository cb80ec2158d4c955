"""Connected components, as the rest of the library has them."""

from mendspan.operators.graph import connected_components

__all__ = ["connected_components"]
