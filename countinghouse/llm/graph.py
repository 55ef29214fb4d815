"""Connected components, which the ledger's fold uses too."""

from ..graph import components

__all__ = ["components"]
