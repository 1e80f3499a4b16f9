"""All driver queries, registered by importing their modules."""

from __future__ import annotations

from importlib import import_module

from hydroseries.plans import catalog_series  # noqa: F401
from hydroseries.plans.registry import ORACLE, QUERIES

for _mod in ("catalog_model", "catalog_raster", "catalog_learn", "catalog_stream", "catalog_extra", "catalog_guard", "catalog_history",
             "catalog_store", "catalog_live"):
    import_module(f"hydroseries.plans.{_mod}")

__all__ = ["QUERIES", "ORACLE"]
