"""Registered queries over the driver's tables, and their DuckDB SQL."""

from . import catalog, outputs

__all__ = ["catalog", "outputs"]
