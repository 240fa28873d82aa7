"""Every query of the library by name, and its SQL for DuckDB."""

from __future__ import annotations

from tilewave.plans import bitstreams, blocks, choices, coders, codes, containers, extras, filters, offsets, pictures, searches, signals, slices, streams, transforms  # noqa: F401  (each module puts its queries into the registry)
from tilewave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
