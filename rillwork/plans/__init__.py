"""Ready-to-run queries over the given tables, one module per family."""

from __future__ import annotations

from importlib import import_module

#: Query modules, in the order their names are listed.
MODULES = (
    "hydrograph_queries",
    "network_queries",
    "ledger_queries",
    "flow_queries",
    "raster_queries",
    "spatial_queries",
    "facility_queries",
    "stream_queries",
)


def load_registry():
    from rillwork.plans.registry import REGISTRY

    for module in MODULES:
        import_module(f"rillwork.plans.{module}")
    return REGISTRY
